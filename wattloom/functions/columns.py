"""Column expressions and projections: time, units, directions, scaling, shares and names."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit factors, the Earth's mean radius, the names of compass sectors and weekdays.
MPH_TO_MPS = 0.44704
JOULES_PER_KWH = 3.6e6
KELVIN = 273.15
EARTH_KM = 6371.0088
CARDINALS = {
    4: ("N", "E", "S", "W"),
    8: ("N", "NE", "E", "SE", "S", "SW", "W", "NW"),
    16: ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"),
}
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- time ---------------------------------------------------------------------------------------------------------


def trunc(unit: str, ts: str | Column) -> Column:
    """date_trunc that stays wall time."""
    return F.date_trunc(unit, c(ts)).cast("timestamp_ntz")


def plus_minutes(ts: str | Column, minutes: int | Column) -> Column:
    return F.timestamp_add("MINUTE", minutes if isinstance(minutes, Column) else F.lit(minutes), c(ts)).cast("timestamp_ntz")


def floor_minutes(ts: str | Column, minutes: int) -> Column:
    """Start of the n-minute interval of the day; n divides an hour, or is a whole number of hours that divides a day."""
    of_day = F.hour(c(ts)) * 60 + F.minute(c(ts))
    return plus_minutes(trunc("day", ts), (F.floor(of_day / minutes) * minutes).cast("int"))


def ceil_minutes(ts: str | Column, minutes: int) -> Column:
    down = floor_minutes(ts, minutes)
    return F.when(down == c(ts), down).otherwise(plus_minutes(down, minutes))


def iso_weekday(ts: str | Column) -> Column:
    """1 (Monday) to 7."""
    return F.weekday(c(ts)) + 1


def iso_year(ts: str | Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), c(ts)).cast("int")


def iso_week(ts: str | Column) -> Column:
    return F.weekofyear(c(ts))


def iso_week_label(ts: str | Column) -> Column:
    return F.concat(iso_year(ts).cast("string"), F.lit("-W"), F.lpad(iso_week(ts).cast("string"), 2, "0"))


def quarter_label(ts: str | Column) -> Column:
    return F.when(c(ts).isNotNull(), F.concat(F.lit("Q"), F.quarter(c(ts)).cast("string")))


def days_in_month(ts: str | Column) -> Column:
    return F.dayofmonth(F.last_day(c(ts)))


def slot(ts: str | Column, minutes: int = 30) -> Column:
    return (F.hour(c(ts)) * (60 // minutes) + F.floor(F.minute(c(ts)) / minutes)).cast("int")


def week_start(ts: str | Column) -> Column:
    """Monday of the week."""
    return F.trunc(c(ts), "week")


def weekday_name(ts: str | Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), iso_weekday(ts))


def add_time_columns(df: DataFrame, ts: str = "date") -> DataFrame:
    return df.withColumns(
        {
            "date_day": F.to_date(c(ts)), "hour": F.hour(ts), "year": F.year(ts), "month": F.month(ts), "weekday": iso_weekday(ts),
            "hour_bin": trunc("hour", ts), "iso_year": iso_year(ts), "iso_week": iso_week(ts),
        }
    )


def day_and_slot(df: DataFrame, ts: str = "date", minutes: int = 30) -> DataFrame:
    return df.withColumns({"day": F.to_date(c(ts)), "slot": slot(ts, minutes)})


def datetime_features(df: DataFrame, ts: str, keep: Sequence[str] | None = None) -> DataFrame:
    out = {
        "year": F.year(ts), "month": F.month(ts), "week_of_year": iso_week(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts), "half_hour": slot(ts),
        "day_of_week": iso_weekday(ts), "is_weekend": (iso_weekday(ts) >= 6).cast("int"), "minute": F.minute(ts), "day_of_year": F.dayofyear(ts),
    }
    return df.withColumns({k: v for k, v in out.items() if keep is None or k in keep})


def fourier_time(df: DataFrame, ts: str) -> DataFrame:
    """sin and cos of the hour, the weekday, the day of the year and the fractional month, and a weekend flag."""
    turns = {
        "hour": (F.hour(ts) + F.minute(ts) / 60) / 24,
        "dow": (iso_weekday(ts) - 1) / 7,
        "doy": F.dayofyear(ts) / 365,
        "month": (F.month(ts) - 1 + (F.dayofmonth(ts) - 1) / days_in_month(ts)) / 12,
    }
    out = {f"{k}_{n}": f(v * 2 * math.pi) for k, v in turns.items() for n, f in (("sin", F.sin), ("cos", F.cos))}
    return df.withColumns(out | {"is_weekend": (iso_weekday(ts) >= 6).cast("int")})


def localise(ts: str | Column, zone: str) -> Column:
    """UTC instant (as wall time) of a wall time in zone."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), c(ts))


def convert(ts: str | Column, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), c(ts))


# --- predicates -----------------------------------------------------------------------------------------------------


def scope_filter(df: DataFrame, city: str | None = None, year: int | None = None, ts: str = "date") -> DataFrame:
    """Optional city and year; the year is a range of ts, which reaches the scan."""
    if city is not None:
        df = df.where(F.col("city") == city)
    return df if year is None else date_range_filter(df, f"{year}-01-01", f"{year + 1}-01-01", ts)


def date_range_filter(df: DataFrame, start: str, end: str, ts: str = "date", closed: bool = False) -> DataFrame:
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return df.where((F.col(ts) >= lo) & ((F.col(ts) <= hi) if closed else (F.col(ts) < hi)))


# --- shares, scaling ------------------------------------------------------------------------------------------------


def analysis_features(df: DataFrame, ts: str, q: str, co2: str, eps: float = 1e-6) -> DataFrame:
    log_q = F.log(F.col(q) + eps)
    return df.withColumns({"time_id": F.date_format(ts, "HH-mm"), "q_squared": F.col(q) * F.col(q), "log_q": log_q, "log_q_squared": log_q * log_q, "log_co2": F.log(F.col(co2) + eps)})


def generation_shares(df: DataFrame, parts: Sequence[str], total: str, scale: float = 100.0, clip: bool = False) -> DataFrame:
    """part / total x scale as <part>_share; null where the total is 0."""
    share = {p: F.try_divide(F.col(p), F.nullif(F.col(total), F.lit(0.0))) * scale for p in parts}
    return df.withColumns({f"{p}_share": F.least(F.greatest(v, F.lit(0.0)), F.lit(scale)) if clip else v for p, v in share.items()})


def net_load(demand: str | Column, renewable: str | Column) -> Column:
    return c(demand) - c(renewable)


def is_sunny(radiation: str | Column, least: float = 1e-4) -> Column:
    return (c(radiation) > least).cast("int")


def log_transform(x: str | Column, eps: float = 1e-6) -> Column:
    return F.log(c(x) + eps)


def log1p_clamped(x: str | Column, least: float = 0.0) -> Column:
    return F.log1p(F.greatest(c(x), F.lit(least)))


def zero_inflated_log(x: str | Column, threshold: float = 0.0) -> tuple[Column, Column]:
    """(occurrence flag, log1p where above the threshold, else 0)."""
    above = c(x) > threshold
    return above.cast("int"), F.when(above, F.log1p(c(x))).otherwise(0.0)


def bounded_logit(p: str | Column, eps: float = 1e-4) -> Column:
    x = F.least(F.greatest(c(p), F.lit(eps)), F.lit(1 - eps))
    return F.log(x / (1 - x))


def polynomial_interactions(df: DataFrame, q: str, degree: int, cols: Sequence[str] = ()) -> DataFrame:
    out = {f"{q}_{k}": F.pow(F.col(q), F.lit(float(k))) for k in range(1, degree + 1)}
    return df.withColumns(out | {f"{q}_x_{x}": F.col(q) * F.col(x) for x in cols})


def winsorize_fit(df: DataFrame, cols: Sequence[str], lower: float = 0.01, upper: float = 0.99) -> dict[str, tuple[float, float]]:
    from wattloom.operators.ranks import exact_quantiles

    return {x: tuple(q) for x, q in exact_quantiles(df, list(cols), [lower, upper]).items()}


def winsorize(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({x: F.least(F.greatest(F.col(x), F.lit(lo)), F.lit(hi)) for x, (lo, hi) in bounds.items()})


def standardise_fit(df: DataFrame, cols: Sequence[str], robust: bool = False) -> dict[str, tuple[float, float]]:
    """(centre, scale) of each column: mean and population deviation, or median and interquartile range; 0 becomes 1."""
    if robust:
        from wattloom.operators.ranks import exact_quantiles

        pairs = {x: (q[1], q[2] - q[0]) for x, q in exact_quantiles(df, list(cols), [0.25, 0.5, 0.75]).items()}
    else:
        row = df.agg(*(f(x).alias(f"{x}_{n}") for x in cols for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        pairs = {x: (row[f"{x}_m"], row[f"{x}_s"]) for x in cols}
    return {x: (m, s or 1.0) for x, (m, s) in pairs.items()}


def standardise(df: DataFrame, params: dict[str, tuple[float, float]], inverse: bool = False) -> DataFrame:
    return df.withColumns({x: F.col(x) * s + m if inverse else (F.col(x) - m) / s for x, (m, s) in params.items()})


def onehot_fit(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Levels of each (categorical, so few-valued) column, ascending."""
    row = df.agg(*(F.array_sort(F.collect_set(x)).alias(x) for x in cols)).first()
    return {x: row[x] for x in cols}


def onehot(df: DataFrame, levels: dict[str, list], drop_first: bool = True) -> DataFrame:
    return df.withColumns({f"{x}_{v}": F.coalesce((F.col(x) == v).cast("int"), F.lit(0)) for x, vs in levels.items() for v in vs[int(drop_first) :]})


# --- wind, units, places --------------------------------------------------------------------------------------------


def wind_to_cyclic(df: DataFrame, degrees: str, meteorological: bool = True) -> DataFrame:
    theta = F.radians(270 - F.col(degrees) if meteorological else F.col(degrees))
    return df.withColumns({f"{degrees}_sin": F.sin(theta), f"{degrees}_cos": F.cos(theta)})


def degrees_to_cardinal(degrees: str | Column, n: int = 8) -> Column:
    step = 360 / n
    return F.element_at(F.array(*map(F.lit, CARDINALS[n])), (F.floor(F.pmod(c(degrees) + step / 2, F.lit(360.0)) / step) + 1).cast("int"))


def wind_from_uv(u: str | Column, v: str | Column) -> tuple[Column, Column]:
    """(speed, meteorological direction)."""
    return F.sqrt(c(u) * c(u) + c(v) * c(v)), F.pmod(270 - F.degrees(F.atan2(c(v), c(u))), F.lit(360.0))


def mph_to_mps(x: str | Column) -> Column:
    return c(x) * MPH_TO_MPS


def metres_to_mm(x: str | Column) -> Column:
    return c(x) * 1000


def kelvin_to_celsius(x: str | Column) -> Column:
    return c(x) - KELVIN


def joules_to_kwh(x: str | Column) -> Column:
    return c(x) / JOULES_PER_KWH


def math_to_meteorological(degrees: str | Column) -> Column:
    return F.pmod(c(degrees) + 180, F.lit(360.0))


def peak_flags(df: DataFrame, ts: str, peaks: DataFrame) -> DataFrame:
    """morning, evening and off-peak flags from a table (dow 1-7, hour, peak 'morning' or 'evening'), 168 rows at most."""
    at = peaks.select(F.col("dow").alias("_dow"), F.col("hour").alias("_hour"), F.col("peak").alias("_peak")).dropDuplicates(["_dow", "_hour"])
    out = df.join(F.broadcast(at), (iso_weekday(ts) == F.col("_dow")) & (F.hour(ts) == F.col("_hour")), "left")
    flags = {f"{p}_peak": F.coalesce((F.col("_peak") == p).cast("int"), F.lit(0)) for p in ("morning", "evening")}
    return out.withColumns(flags | {"off_peak": F.col("_peak").isNull().cast("int")}).drop("_dow", "_hour", "_peak")


def haversine_km(lat1: str | Column, lon1: str | Column, lat2: str | Column, lon2: str | Column) -> Column:
    a1, o1, a2, o2 = (F.radians(c(x)) for x in (lat1, lon1, lat2, lon2))
    s, t = F.sin((a2 - a1) / 2), F.sin((o2 - o1) / 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), s * s + F.cos(a1) * F.cos(a2) * t * t)))


def filter_by_radius(df: DataFrame, lat: str, lon: str, center: tuple[float, float], km: float) -> DataFrame:
    """Rows within km of center; a latitude band, which reaches the scan, comes first. Null places go."""
    band = math.degrees(km / EARTH_KM)
    near = F.col(lat).between(center[0] - band, center[0] + band)
    return df.where(near & (haversine_km(lat, lon, F.lit(center[0]), F.lit(center[1])) <= km))


# --- energy and emissions -------------------------------------------------------------------------------------------


def grams_from_kwh(kwh: str | Column, grams_per_kwh: str | Column) -> Column:
    return c(kwh) * c(grams_per_kwh)


def tonnes_from_grams(grams: str | Column) -> Column:
    return c(grams) / 1e6


def me_grams_per_kwh(tons_per_mw: str | Column, hours: float = 0.5) -> Column:
    """Marginal tonnes in an interval for each MW held over it, as grams for each kWh."""
    return c(tons_per_mw) / hours * 1000


def mw_to_kwh(mw: str | Column, hours: float = 0.5) -> Column:
    return c(mw) * hours * 1000


def fuel_emissions(thermal_mw: str | Column, gas_mw: str | Column, thermal_factor: str | Column, gas_factor: str | Column, minutes: int) -> tuple[Column, Column]:
    """(thermal, gas) tonnes in an interval of 5 or 30 minutes; factors in tonnes for each MWh."""
    if minutes not in (5, 30):
        raise ValueError("intervals have 5 or 30 minutes")
    hours = minutes / 60
    return c(thermal_mw) * c(thermal_factor) * hours, c(gas_mw) * c(gas_factor) * hours


def sanitize_city(city: str | Column) -> Column:
    return F.regexp_replace(F.lower(c(city)), "[^a-z0-9_-]", "_")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once a row: inside a lambda, the optimizer would put its expression in place of its
    name, to be worked out again for every element."""
    return F.get(F.transform(F.array(value), f), 0)


def classify_move(delta_grams: str | Column) -> Column:
    return F.when(c(delta_grams) < 0, "savings").when(c(delta_grams) > 0, "increases").otherwise("neutral")


def shift_direction(delta_minutes: str | Column) -> Column:
    return F.when(c(delta_minutes) > 0, "forward").when(c(delta_minutes) < 0, "backward").otherwise("stay")


def slots_of_hours(hours: float, minutes: int = 30) -> int:
    return int(round(hours * 60 / minutes))


# --- names ----------------------------------------------------------------------------------------------------------


def drop_columns(df: DataFrame, names: Sequence[str], errors: str = "ignore") -> DataFrame:
    missing = [x for x in names if x not in df.columns]
    if missing and errors == "raise":
        raise KeyError(f"no columns {missing}")
    return df.drop(*names)


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return require_columns(df, names).select(*names)


def canonical_columns(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Renames the first alias present of each canonical name that is absent."""
    found = {next(a for a in alias if a in df.columns): name for name, alias in aliases.items() if name not in df.columns and any(a in df.columns for a in alias)}
    return df.withColumnsRenamed(found)


def resolve_column(df: DataFrame, name: str) -> str:
    """The column that equals name but for case and punctuation."""
    plain = lambda s: "".join(x for x in s.lower() if x.isalnum())
    found = [x for x in df.columns if plain(x) == plain(name)]
    if len(found) != 1:
        raise KeyError(f"{name}: {found or 'none'} of {df.columns}")
    return found[0]


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [x for x in names if x not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    return df

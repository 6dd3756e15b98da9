"""Gap filling with an audit trail, de-accumulation, and hourly to half-hourly weather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.columns import plus_minutes, wind_from_uv
from wattloom.operators.quality import run_ids

AUDIT = "processing_operations_log"
_AUDIT_TYPE = "array<struct<column:string,method:string>>"


def ensure_audit(df: DataFrame) -> DataFrame:
    return df if AUDIT in df.columns else df.withColumn(AUDIT, F.array().cast(_AUDIT_TYPE))


def record_event(df: DataFrame, mask: Column, column: str, method: str) -> DataFrame:
    """Appends (column, method) to the audit of the rows where mask holds."""
    event = F.struct(F.lit(column).alias("column"), F.lit(method).alias("method"))
    return ensure_audit(df).withColumn(AUDIT, F.when(F.coalesce(mask, F.lit(False)), F.array_append(AUDIT, event)).otherwise(F.col(AUDIT)))


def _fill(df: DataFrame, col: str, mask: Column, value: Column, method: str) -> DataFrame:
    """Sets col to value where mask holds and value isn't null, and records it."""
    out = ensure_audit(df).withColumns({"_m": mask & value.isNotNull(), "_v": value})
    out = record_event(out, F.col("_m"), col, method)
    return out.withColumn(col, F.when(F.col("_m"), F.col("_v")).otherwise(F.col(col))).drop("_m", "_v")


def impute_isolated(df: DataFrame, cols: Sequence[str], keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Nulls between two values become their mean ('avg_of_neighbors')."""
    w = Window.partitionBy(*keys).orderBy(ts)
    for x in cols:
        before, after = F.lag(x).over(w), F.lead(x).over(w)
        df = _fill(df, x, F.col(x).isNull(), (before + after) / 2, "avg_of_neighbors")
    return df


def _with_filler(df: DataFrame, filler: DataFrame, mapping: dict[str, str], on: Sequence[str]) -> DataFrame:
    side = filler.dropDuplicates(list(on)).select(*on, *(F.col(v).alias(f"_f_{k}") for k, v in mapping.items()))
    return df.join(side, list(on), "left")


def fill_hours_from(df: DataFrame, filler: DataFrame, mapping: dict[str, str], on: Sequence[str], hours: Sequence[int] = (0,), overwrite: bool = False, ts: str = "timestamp") -> DataFrame:
    """At the given hours, nulls (or all values) of each column from the mapped filler column."""
    out = _with_filler(df, filler, mapping, on)
    for x in mapping:
        out = _fill(out, x, F.hour(ts).isin(*hours) & (F.lit(overwrite) | F.col(x).isNull()), F.col(f"_f_{x}"), "filled_from_filler_at_hour")
    return out.drop(*(f"_f_{x}" for x in mapping))


def fill_long_gaps_from(df: DataFrame, filler: DataFrame, mapping: dict[str, str], on: Sequence[str], keys: Sequence[str], min_gap: int = 2, ts: str = "timestamp") -> DataFrame:
    """Runs of at least min_gap nulls or NaNs from the mapped filler column."""
    out = _with_filler(df, filler, mapping, on)
    for x in mapping:
        gone = F.col(x).isNull() | F.isnan(F.col(x).cast("double"))
        runs = run_ids(out, gone, keys, ts).withColumn("_len", F.count("*").over(Window.partitionBy(*keys, "run_id")))
        out = _fill(runs, x, F.col("_null") & (F.col("_len") >= min_gap), F.col(f"_f_{x}"), "filled_long_gap").drop("_null", "run_id", "_len")
    return out.drop(*(f"_f_{x}" for x in mapping))


def fill_intervals_from(df: DataFrame, filler: DataFrame, mapping: dict[str, str], on: Sequence[str]) -> DataFrame:
    """Nulls of each column from the mapped filler column; the filler is deduplicated by its keys."""
    out = _with_filler(df, filler, mapping, on)
    for x in mapping:
        out = _fill(out, x, F.col(x).isNull(), F.col(f"_f_{x}"), "filled_from_filler")
    return out.drop(*(f"_f_{x}" for x in mapping))


def add_filler_columns(df: DataFrame, filler: DataFrame, cols: Sequence[str], on: Sequence[str]) -> DataFrame:
    return df.join(filler.select(*on, *cols), list(on), "left")


def fill_guarded(df: DataFrame, cols: Sequence[str], keys: Sequence[str], window_minutes: int = 30, ts: str = "timestamp") -> DataFrame:
    """Interior gaps linearly in time; gaps at an edge from the nearest value if it is within window_minutes."""
    w = Window.partitionBy(*keys).orderBy(ts)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    for x in cols:
        at = F.when(F.col(x).isNotNull(), F.col(ts))
        v0, t0 = F.last(x, True).over(back), F.last(at, True).over(back)
        v1, t1 = F.first(x, True).over(ahead), F.first(at, True).over(ahead)
        since, until = F.timestamp_diff("SECOND", t0, F.col(ts)), F.timestamp_diff("SECOND", F.col(ts), t1)
        line = v0 + (v1 - v0) * since / F.nullif(since + until, F.lit(0))
        edge = F.when(v1.isNull() & (since <= window_minutes * 60), v0).when(v0.isNull() & (until <= window_minutes * 60), v1)
        df = df.withColumn(x, F.coalesce(F.col(x), line, edge))
    return df


def deaccumulate(df: DataFrame, cols: Sequence[str], keys: Sequence[str], start_hour: int = 1, ts: str = "timestamp") -> DataFrame:
    """<col>_increment: hourly increments of values that accumulate within a day, not below 0; null before start_hour,
    the value itself at start_hour."""
    w = Window.partitionBy(*keys, F.to_date(ts)).orderBy(ts)
    for x in cols:
        step = F.greatest(F.col(x) - F.lag(x).over(w), F.lit(0.0))
        df = df.withColumn(f"{x}_increment", F.when(F.hour(ts) < start_hour, None).when(F.hour(ts) == start_hour, F.greatest(F.col(x), F.lit(0.0))).when((F.col(x) - F.lag(x).over(w)).isNotNull(), step))
        df = record_event(df, (F.hour(ts) > start_hour) & F.col(f"{x}_increment").isNotNull(), x, "deaccumulated")
    return df


def interval_columns(df: DataFrame, cols: Sequence[str], start_hour: int = 1, ts: str = "timestamp") -> DataFrame:
    """<col>_interval: the raw value before start_hour, else the increment."""
    return df.withColumns({f"{x}_interval": F.when(F.hour(ts) < start_hour, F.col(x)).otherwise(F.col(f"{x}_increment")) for x in cols})


# --- hourly to half-hourly -------------------------------------------------------------------------------------------


def _ordered(keys: Sequence[str], ts: str) -> Window:
    return Window.partitionBy(*keys).orderBy(ts)


def _halves(df: DataFrame, keys: Sequence[str], ts: str, halves: dict[str, tuple[Column, Column]], stamp: str) -> DataFrame:
    """Two rows for each hour; stamped at its end, an hour at t covers (t-60, t], at its start [t, t+60)."""
    first, second = (-30, 0) if stamp == "end" else (30, 60)
    rows = F.array(*(F.struct(plus_minutes(ts, m).alias(ts), *(h[i].alias(x) for x, h in halves.items())) for i, m in enumerate((first, second))))
    return df.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def split_even(df: DataFrame, cols: Sequence[str], keys: Sequence[str], ts: str = "timestamp", stamp: str = "end") -> DataFrame:
    """Hourly amounts in two equal halves, of hours whose neighbour (the one before, stamped at the end; the one after,
    stamped at the start) is 60 minutes away. Half-hours are stamped at their ends."""
    w = _ordered(keys, ts)
    apart = F.timestamp_diff("MINUTE", F.lag(ts).over(w), F.col(ts)) if stamp == "end" else F.timestamp_diff("MINUTE", F.col(ts), F.lead(ts).over(w))
    kept = df.withColumn("_gap", apart).where(F.col("_gap") == 60)
    return _halves(kept, keys, ts, {x: (F.col(x) / 2, F.col(x) / 2) for x in cols}, stamp)


def split_rate_shaped(df: DataFrame, cols: Sequence[str], keys: Sequence[str], ts: str = "timestamp", stamp: str = "end") -> DataFrame:
    """Hourly amounts in halves shaped by the neighbours' rates, which add up to the amount; missing neighbours count
    as the hour itself, and hours whose shape has no mass are halved."""
    w = _ordered(keys, ts)
    out, halves = df, {}
    for x in cols:
        cur = F.col(x)
        r0, r1 = (F.coalesce(F.lag(x).over(w), cur) + cur) / 2, (cur + F.coalesce(F.lead(x).over(w), cur)) / 2
        e1, e2 = r0 / 2 + (r1 - r0) / 8, r1 / 2 - (r1 - r0) / 8
        share = F.coalesce(F.try_divide(e1, F.nullif(e1 + e2, F.lit(0.0))), F.lit(0.5))
        out = out.withColumn(f"_{x}", share)
        halves[x] = (cur * F.col(f"_{x}"), cur - cur * F.col(f"_{x}"))
    return _halves(out, keys, ts, halves, stamp)


def midpoint(df: DataFrame, cols: Sequence[str], keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Half-past rows with the mean of the hour's and the next hour's values, where the next hour is there."""
    w = _ordered(keys, ts)
    out = df.select(*keys, ts, F.timestamp_diff("MINUTE", F.col(ts), F.lead(ts).over(w)).alias("_gap"), *(((F.col(x) + F.lead(x).over(w)) / 2).alias(x) for x in cols))
    return out.where(F.col("_gap") == 60).withColumn(ts, plus_minutes(ts, 30)).drop("_gap")


def wind_midpoint(df: DataFrame, speed: str, direction: str, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Half-past rows with the mean speed and the speed-weighted circular mean of the direction."""
    w = _ordered(keys, ts)
    x, y = F.col(speed) * F.cos(F.radians(direction)), F.col(speed) * F.sin(F.radians(direction))
    with_xy = df.withColumns({"_x": x, "_y": y})
    mean = lambda col: (F.col(col) + F.lead(col).over(w)) / 2
    out = with_xy.select(*keys, ts, F.timestamp_diff("MINUTE", F.col(ts), F.lead(ts).over(w)).alias("_gap"), mean(speed).alias(speed), F.pmod(F.degrees(F.atan2(mean("_y"), mean("_x"))), F.lit(360.0)).alias(direction))
    return out.where(F.col("_gap") == 60).withColumn(ts, plus_minutes(ts, 30)).drop("_gap")


def static_fill(df: DataFrame, cols: Sequence[str], keys: Sequence[str], how: str = "current", ts: str = "timestamp") -> DataFrame:
    """Half-past rows with the value of the hour ('current'), the next one, or whichever there is ('nearest')."""
    w = _ordered(keys, ts)
    pick = {"current": lambda x: F.col(x), "next": lambda x: F.lead(x).over(w), "nearest": lambda x: F.coalesce(F.col(x), F.lead(x).over(w))}[how]
    out = df.select(*keys, ts, F.timestamp_diff("MINUTE", F.col(ts), F.lead(ts).over(w)).alias("_gap"), *(pick(x).alias(x) for x in cols))
    return out.where(F.col("_gap") == 60).withColumn(ts, plus_minutes(ts, 30)).drop("_gap")


def to_half_hourly(
    df: DataFrame,
    keys: Sequence[str],
    even: Sequence[str] = (),
    shaped: Sequence[str] = (),
    means: Sequence[str] = (),
    wind: tuple[str, str] | None = None,
    static: Sequence[str] = (),
    shares: Sequence[str] = (),
    ts: str = "timestamp",
    stamp: str = "end",
) -> DataFrame:
    """All of the above on one half-hourly grid: amounts split, other values kept on the hour and interpolated at half
    past, shares (such as cloud cover) also clipped to [0, 1]."""
    points = [*means, *shares]
    hour = df.select(*keys, ts, *points, *(wind or ()), *static)
    parts = [hour]
    half: DataFrame | None = None
    for made in (
        midpoint(df, points, keys, ts) if points else None,
        wind_midpoint(df, *wind, keys, ts) if wind else None,
        static_fill(df, static, keys, "nearest", ts) if static else None,
    ):
        if made is not None:
            half = made if half is None else half.join(made, [*keys, ts], "full")
    out = parts[0] if half is None else parts[0].unionByName(half)
    for amounts, split in ((even, split_even), (shaped, split_rate_shaped)):
        if amounts:
            out = out.join(split(df, amounts, keys, ts, stamp), [*keys, ts], "full")
    return out.withColumns({x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) for x in shares}) if shares else out


def wind_columns(df: DataFrame, u: str, v: str) -> DataFrame:
    speed, direction = wind_from_uv(u, v)
    return df.withColumns({"wind_speed": speed, "wind_direction": direction})

"""Joins: factors, locations, nearest places, roles, checked keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.columns import haversine_km, iso_weekday
from wattloom.operators.places import nearest
from wattloom.sources.io import kept


def join_factors(marginal: DataFrame, average: DataFrame, on: str | Sequence[str] = "timestamp") -> DataFrame:
    return marginal.join(average, on, "left")


def join_models(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """Left join on keys; columns that both sides have get suffix on the right."""
    return left.join(right.withColumnsRenamed({x: x + suffix for x in right.columns if x not in keys and x in left.columns}), list(keys), "left")


def join_location(readings: DataFrame, mapping: DataFrame, on: str = "ca_id") -> DataFrame:
    return readings.join(mapping, on, "left")


def join_time_location(readings: DataFrame, factors: DataFrame, on: Sequence[str] = ("date", "location_id")) -> DataFrame:
    return readings.join(factors, list(on), "left")


def fill_from_city_average(df: DataFrame, averages: DataFrame, cols: Sequence[str], on: Sequence[str] = ("city", "date")) -> DataFrame:
    """Nulls of cols from the city's mean series."""
    side = averages.select(*on, *(F.col(x).alias(f"_{x}") for x in cols))
    return df.join(side, list(on), "left").withColumns({x: F.coalesce(x, f"_{x}") for x in cols}).drop(*(f"_{x}" for x in cols))


def city_mean_factors(df: DataFrame, cols: Sequence[str], on: Sequence[str] = ("city", "timestamp")) -> DataFrame:
    return df.where(F.col(on[0]).isNotNull()).groupBy(*on).agg(*(F.avg(x).alias(x) for x in cols))


def stack_grid_weather(weather: DataFrame, grid: DataFrame, on: str = "timestamp") -> DataFrame:
    return weather.join(grid, on, "inner")


def needed_rows(df: DataFrame, wanted: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(wanted, on, "left_semi")


def without_rows(df: DataFrame, dropped: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(dropped, on, "left_anti")


def merge_parts(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full join of all parts, with one set of key columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys), "full")
    return out


def validated_left_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which a key of the right that repeats is an error: it is raised when the result is read."""
    others = [x for x in right.columns if x not in on]
    many = F.raise_error(F.concat(F.lit("join keys repeat: "), F.concat_ws(", ", *(F.col(x).cast("string") for x in on))))
    one = right.groupBy(*on).agg(*(F.first(x).alias(x) for x in others), F.count("*").alias("_n")).withColumn("_ok", F.when(F.col("_n") > 1, many).otherwise(F.lit("")))
    out = left.join(one, list(on), "left").where(F.coalesce("_ok", F.lit("")) == "")
    return out.drop("_n", "_ok")


def number_locations(df: DataFrame, cols: Sequence[str], name: str = "location_id") -> tuple[DataFrame, DataFrame]:
    """(df with name, lookup): distinct places numbered from 0 in their order. Places are a dimension, numbered in one task."""
    lookup = df.select(*cols).distinct().withColumn(name, F.row_number().over(Window.orderBy(*cols)).cast("long") - 1)
    return df.join(lookup, list(cols), "left"), lookup


def moves_by_role(moves: DataFrame, labels: DataFrame, time: str = "timestamp", label: str = "confidence", on: Sequence[str] = ("city",)) -> DataFrame:
    """moves with the label at the source time, at the destination time, and the first of them that there is."""
    side = lambda at, name: labels.select(*on, F.col(time).alias(at), F.col(label).alias(name))
    out = moves.join(side("original_time", f"source_{label}"), [*on, "original_time"], "left")
    out = out.join(side("proposed_shift_time", f"destination_{label}"), [*on, "proposed_shift_time"], "left")
    return out.withColumn(label, F.coalesce(f"source_{label}", f"destination_{label}"))


def emission_factor_years(factors: DataFrame, first: int, last: int) -> DataFrame:
    """A row for each year of the range: missing years take the next year's factors, years outside the table the nearest's."""
    cols = [x for x in factors.columns if x != "year"]
    span = factors.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    years = factors.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    w = Window.orderBy("year").rowsBetween(0, Window.unboundedFollowing)
    inside = factors.sparkSession.range(1).crossJoin(span).select(F.explode(F.sequence("lo", "hi")).alias("year")).join(factors, "year", "left")
    filled = inside.withColumns({x: F.first(x, ignorenulls=True).over(w) for x in cols})
    at = years.crossJoin(F.broadcast(span)).select("year", F.least(F.greatest("year", "lo"), "hi").alias("_at"))
    return at.join(filled.withColumnRenamed("year", "_at"), "_at", "left").drop("_at")


def add_emission_factors(df: DataFrame, factors: DataFrame, first: int, last: int, ts: str = "timestamp") -> DataFrame:
    """df with the factors of the timestamp's year; years beyond the range take the nearest one's."""
    table = emission_factor_years(factors, first, last).withColumnRenamed("year", "_year")
    at = F.least(F.greatest(F.year(ts), F.lit(first)), F.lit(last))
    return df.join(F.broadcast(table), at == F.col("_year"), "left").drop("_year")


def year_specific_emissions(df: DataFrame, factors: DataFrame, first: int, last: int, minutes: int, thermal: str = "thermal", gas: str = "gas", recorded: str = "tons_co2") -> DataFrame:
    """Tonnes by fuel, their total, and its difference from the recorded tonnes, absolute and relative."""
    from wattloom.functions.columns import fuel_emissions

    t, g = fuel_emissions(thermal, gas, "thermal_factor", "gas_factor", minutes)
    out = add_emission_factors(df, factors, first, last).withColumns({"thermal_tons": t, "gas_tons": g})
    out = out.withColumn("fuel_tons", F.col("thermal_tons") + F.col("gas_tons")).withColumn("difference", F.col("fuel_tons") - F.col(recorded))
    return out.withColumn("relative_difference", F.try_divide("difference", F.nullif(F.col(recorded), F.lit(0.0))))


def attach_household_floor(readings: DataFrame, floors: DataFrame, default: float = 0.0, ts: str = "date") -> DataFrame:
    out = readings.withColumns({"hod": F.hour(ts), "dow": iso_weekday(ts)}).join(floors, ["ca_id", "hod", "dow"], "left")
    return out.withColumn("floor_kwh", F.coalesce("floor_kwh", F.lit(default))).drop("hod", "dow")


#: References that every task may hold for a comparison with each point.
FEW_REFERENCES = 2_000


def nearest_location(points: DataFrame, refs: DataFrame, point_id: str, ref_id: str, metric: str = "haversine") -> DataFrame:
    """points with the id and the distance (km, or degrees for metric 'planar') of the nearest of refs; the smallest id of equals.

    Both have lon and lat; points without a place get nulls. Up to FEW_REFERENCES references go to each task. More are
    matched by cells as broad as each point's distance to references beside it on a curve (places.nearest).
    """
    r = refs.select(F.col(ref_id).alias("_ref"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).where(F.col("_lon").isNotNull() & F.col("_lat").isNotNull())
    placed = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    if r.limit(FEW_REFERENCES + 1).count() <= FEW_REFERENCES:
        planar = F.sqrt(F.pow(F.col("lon") - F.col("_lon"), F.lit(2.0)) + F.pow(F.col("lat") - F.col("_lat"), F.lit(2.0)))
        distance = haversine_km("lat", "lon", "_lat", "_lon") if metric == "haversine" else planar
        best = F.min(F.struct(distance.alias("distance"), F.col("_ref").alias("id")))
        near = placed.select(point_id, "lon", "lat").join(F.broadcast(r), how="cross").groupBy(point_id).agg(best.alias("_best"))
    else:
        there = r.select("_ref", F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))
        near = nearest(placed.select(point_id, "lon", "lat"), there, [], point_id, "_ref", metric).groupBy(point_id).agg(F.min("best").alias("_best"))
    near = near.select(point_id, F.col("_best.id").alias(ref_id), F.col("_best.distance").alias("distance"))
    return points.join(near, point_id, "left")


def neighbour_distances(points: DataFrame, by: Sequence[str] = ("city",), id_col: str = "ca_id") -> DataFrame:
    """Mean, median, least and largest distance (km) to the nearest other point of the same group, and how many points
    have one. A point alone in its group has none; points at one place are 0 apart.

    The cells in which a place looks for its nearest are as broad as its distance to others beside it on a curve
    (places.nearest), so that dense cities and far outliers take the same joins.
    """
    places = kept(points.where("lon is not null and lat is not null").groupBy(*by, "lon", "lat").agg(F.count("*").alias("n"), F.min(id_col).alias("a")))
    shared = places.where("n > 1").select(*by, "n", F.lit(0.0).alias("km"))
    alone = nearest(places.where("n = 1"), places, by, "a", "a", apart=True)
    out = shared.unionByName(alone.select(*by, F.lit(1).cast("long").alias("n"), F.col("best.distance").alias("km")))
    stats = {"mean": F.sum(F.col("km") * F.col("n")) / F.sum("n"), "median": F.percentile("km", F.lit(0.5), F.col("n")), "min": F.min("km"), "max": F.max("km")}
    return out.groupBy(*by).agg(*(f.alias(f"{n}_km") for n, f in stats.items()), F.sum("n").alias("points"))


def pair_distances(points: DataFrame, by: Sequence[str] = ("city",), id_col: str = "ca_id", seed: int = 42) -> DataFrame:
    """Distance statistics (km) of seeded random pairs: each point with the next one in a hashed order of its group."""
    buckets = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1024))
    w = Window.partitionBy(*by, "_b").orderBy("_h", id_col)
    nxt = points.withColumns({"_b": buckets, "_h": F.xxhash64(F.lit(seed + 1), id_col)}).withColumns({"lon2": F.lead("lon").over(w), "lat2": F.lead("lat").over(w)})
    km = nxt.where(F.col("lon2").isNotNull()).select(*by, haversine_km("lat", "lon", "lat2", "lon2").alias("km"))
    return km.groupBy(*by).agg(F.avg("km").alias("mean_km"), F.percentile("km", F.lit(0.5)).alias("median_km"), F.min("km").alias("min_km"), F.max("km").alias("max_km"), F.count("*").alias("pairs"))

"""Exact nearest places by cells that follow the local density, in a fixed number of joins.

Each place first gets a bound: its distance to the places beside it on a space-filling curve, in three shifted grids, of
which one has a near neighbour in the same small cell. The grid whose cells are just as broad as the bound then has the
nearest place in the 3 x 3 cells around. Few places of a cell have bounds as broad as it, however dense others are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.columns import EARTH_KM, haversine_km
from wattloom.sources.io import kept

#: Grids from cells of 720 degrees on, each half as broad as the one before.
LEVELS = 40
#: The grid of one cell, for bounds that no other can hold.
WHOLE = -1
_BITS = 26


def _spread(x: Column) -> Column:
    """The bits of x on every second place."""
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
    return x


def _curve(shift: Column) -> Column:
    """The place on the curve; what lies outside the sphere's degrees is put at their edge, which only loosens bounds."""
    on = lambda x, half: F.floor(F.least(F.greatest((F.col(x) + half) / (2 * half), F.lit(0.0)), F.lit(1.0)) / 2 * 2**_BITS + shift * (2**_BITS / 6))
    return _spread(on("_x", 180.0)).bitwiseOR(F.shiftleft(_spread(on("_y", 90.0)), 1))


def _distance(metric: str) -> Column:
    if metric == "haversine":
        return haversine_km("lat", "lon", "_lat", "_lon")
    return F.sqrt(F.pow(F.col("lon") - F.col("_lon"), F.lit(2.0)) + F.pow(F.col("lat") - F.col("_lat"), F.lit(2.0)))


def _level(metric: str) -> Column:
    """The finest grid in which a place within the bound can't lie beyond the next cell."""
    holds = []
    for n in range(LEVELS, -1, -1):
        size = 720 / 2**n
        reach = F.lit(size)
        if metric == "haversine":
            # a cell's breadth in km is least at the pole side of the next cell; beyond the date line is another cell
            reach = size * math.radians(1) * EARTH_KM * F.greatest(F.lit(0.0), F.cos(F.radians(F.least(F.abs("lat") + size, F.lit(90.0)))))
            reach = F.when(F.abs("_x") + size <= 180, reach)
        holds.append(F.when(reach >= F.col("_bound") * (1 + 1e-9), n))
    return F.coalesce(*holds, F.lit(WHOLE))


def _bounded(rows: DataFrame, metric: str) -> DataFrame:
    """The points among rows with _level, from their distances to the references before and after them on the curve."""
    long = rows.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("_s")).withColumn("_z", _curve(F.col("_s")))
    order = ["_z", "_id", "_lon", "_lat"]
    long = long.withColumnsRenamed({"lon": "_lon", "lat": "_lat"})
    dealt = kept(long.repartitionByRange("_s", "_by", *order).withColumn("_part", F.spark_partition_id()))
    ref = F.when(F.col("_ref"), F.struct("_lon", "_lat"))
    part = Window.partitionBy("_s", "_by", "_part")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # references of the ranges before and after, for rows that have none in their own
    ends = dealt.where("_ref").groupBy("_s", "_by", "_part").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))
    ends = dealt.select("_s", "_by", "_part").distinct().join(ends, ["_s", "_by", "_part"], "left")
    group = Window.partitionBy("_s", "_by")
    other = lambda c, w: F.last(F.when(F.col(c).isNotNull(), F.struct(f"{c}._lon", f"{c}._lat")), True).over(upto(w))
    ends = ends.select("_s", "_by", "_part", other("last", group.orderBy("_part")).alias("_far0"), other("first", group.orderBy(F.desc("_part"))).alias("_far1"))
    sides = dealt.withColumns({"_near0": F.last(ref, True).over(upto(part.orderBy(*order))), "_near1": F.last(ref, True).over(upto(part.orderBy(*map(F.desc, order))))})
    sides = sides.where("_point").join(ends, ["_s", "_by", "_part"]).withColumnsRenamed({"_lon": "lon", "_lat": "lat"})
    sides = sides.select("_by", "_id", "lon", "lat", "_x", "_y", F.explode(F.array(*(F.coalesce(f"_near{i}", f"_far{i}") for i in (0, 1)))).alias("_side"))
    bound = sides.withColumns({"_lon": F.col("_side._lon"), "_lat": F.col("_side._lat")}).groupBy("_by", "_id", "lon", "lat", "_x", "_y").agg(F.min(_distance(metric)).alias("_bound"))
    return bound.withColumn("_level", _level(metric))


def nearest(points: DataFrame, refs: DataFrame, by: Sequence[str], point_id: str, ref_id: str, metric: str = "haversine", apart: bool = False) -> DataFrame:
    """by, point_id, lon, lat, best: struct(distance, id) of the nearest of refs with the same by, the smallest id of
    equals; points without one have no row. apart: references at the very place of a point don't count.

    Both have lon and lat, none null. Nulls in by are equal. Points whose cells would cross the date line or a pole meet
    all references of their group.
    """
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    turned = F.col("lon") - 360 * F.floor((F.col("lon") + 180) / 360) if metric == "haversine" else F.col("lon")
    keyed = lambda t, key: t.select(group.alias("_by"), *by, F.col(key).alias("_id"), "lon", "lat", turned.alias("_x"), F.col("lat").alias("_y"))
    probes, others = keyed(points, point_id), keyed(refs, ref_id)
    marked = lambda t, point: t.drop(*by).withColumns({"_ref": F.lit(not point), "_point": F.lit(point)})
    # ids of the two sides may have different types
    rows = marked(probes, True).unionByName(marked(others, False).withColumn("_id", F.lit(None)))
    if apart:
        rows = rows.groupBy("_by", "lon", "lat", "_x", "_y").agg(F.max("_id").alias("_id"), F.max("_ref").alias("_ref"), F.max("_point").alias("_point"))
    bounded = kept(_bounded(rows, metric))
    levels = sorted(r[0] for r in bounded.select("_level").distinct().collect()) or [WHOLE]
    size = 720 / F.pow(F.lit(2.0), F.col("_level"))
    at = {c: F.when(F.col("_level") == WHOLE, F.lit(0)).otherwise(F.floor(F.col(x) / size)).cast("long") for c, x in (("_cx", "_x"), ("_cy", "_y"))}
    steps = [F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias(x) for x in ("_dx", "_dy")]
    around = bounded.withColumns(at).select("*", steps[0]).select("*", steps[1]).withColumns({"_cx": F.col("_cx") + F.col("_dx"), "_cy": F.col("_cy") + F.col("_dy")})
    there = others.select("_by", F.col("_id").alias("_rid"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), "_x", "_y", F.explode(F.array(*map(F.lit, levels))).alias("_level"))
    met = around.drop("_x", "_y").join(there.withColumns(at).drop("_x", "_y"), ["_by", "_level", "_cx", "_cy"])
    met = met.where("lon <> _lon or lat <> _lat") if apart else met
    best = met.groupBy("_by", "_id", "lon", "lat").agg(F.min(F.struct(_distance(metric).alias("distance"), F.col("_rid").alias("id"))).alias("best"))
    best = best.join(probes.select("_by", *by).distinct(), "_by") if by else best
    return best.select(*by, F.col("_id").alias(point_id), "lon", "lat", "best")

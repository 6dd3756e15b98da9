"""Exact places, ranks, running sums and quantiles, of whole tables and of groups of any size.

Rows are sorted over ranges of (group, value), so that a large group spreads over many tasks. Each task adds up its own
rows; the sums of the ranges before, a row for each group and range, are added afterwards.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.sources.io import kept, scratch


def _ordered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: str) -> DataFrame:
    """df as a written table, sorted over ranges, with _part (the range) and _run (sum of n of the rows of the range before)."""
    kind = df.schema[n].dataType.simpleString()
    names = [*df.columns, "_part", "_run"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            if b.num_rows:
                run = np.append(0, np.cumsum(b.column(n).to_numpy(zero_copy_only=False))) + before
                before = run[-1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(run[:-1])], names)

    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return kept(dealt.mapInArrow(summed, f"{fields}, _part int, _run {kind}"))


def _parts(ordered: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """keys, _part, _start (its first _run), _n (its sum), _before (the sum of the group's ranges before), _total."""
    sums = ordered.groupBy(*keys, "_part").agg(F.min("_run").alias("_start"), F.sum(n).alias("_n"))
    w = Window.partitionBy(*keys)
    return sums.withColumns({"_before": F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), "_total": F.sum("_n").over(w)}).na.fill(0, ["_before"])


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal keys, null being equal to null; the keys are the left's."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    other = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys], how).drop(*(f"_on_{k}" for k in keys))


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: str) -> DataFrame:
    """df with below (sum of n over the rows of the same keys that come before in the order) and total (over all rows of
    the keys). The order must leave no ties that matter; n has no nulls."""
    ordered = _ordered(df, keys, order, n)
    out = same(ordered, _parts(ordered, keys, n).drop("_n"), [*keys, "_part"])
    return out.withColumns({"below": F.col("_before") + F.col("_run") - F.col("_start"), "total": F.col("_total")}).drop("_part", "_run", "_start", "_before", "_total")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows of the same keys up to this one; nulls count as 0."""
    out = placed(df.withColumn("_v", F.coalesce(value, F.lit(0))), keys, order, "_v")
    return out.withColumn(name, F.col("below") + F.col("_v")).drop("_v", "below", "total")


def level_quantiles(levels: DataFrame, keys: Sequence[str], probs: Sequence[float], midpoint: bool = False) -> DataFrame:
    """keys, q (array of double, one for each of probs): linear quantiles of v, each value n times.

    levels: keys, v, n, with no v twice for the same keys. midpoint: the middle of the two values around a place.
    """
    ordered = _ordered(levels.where("v is not null"), keys, ["v"], "n")
    parts = _parts(ordered, keys, "n")
    chances = F.array(*(F.lit(float(p)) for p in probs))
    at = parts.select("*", F.posexplode(chances).alias("_i", "_p")).withColumn("_at", F.col("_p") * (F.col("_total") - 1))
    sides = F.array(F.floor(F.col("_at") + 1e-9), F.ceil(F.col("_at") - 1e-9))
    want = at.select("*", F.posexplode(sides).alias("_side", "_place")).where((F.col("_place") >= F.col("_before")) & (F.col("_place") < F.col("_before") + F.col("_n")))
    want = want.select(*keys, "_part", "_i", "_at", "_side", (F.col("_start") + F.col("_place") - F.col("_before")).alias("_place"))
    hit = same(ordered, want, [*keys, "_part"]).where((F.col("_place") >= F.col("_run")) & (F.col("_place") < F.col("_run") + F.col("n")))
    # a row for each probability and side
    ends = hit.groupBy(*keys, "_i", "_at").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    part = F.col("_at") - F.floor(F.col("_at") + 1e-9)
    part = F.when(part > 1e-9, 0.5).otherwise(0.0) if midpoint else part
    values = ends.withColumn("q", F.col("lo") + (F.col("hi") - F.col("lo")) * part)
    return values.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "q"))), lambda x: x["q"]).alias("q"))


def _levels(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, column, v, n: how often each value of cols that isn't null occurs in each group."""
    if len(cols) == 1:
        long = df.select(*by, F.lit(cols[0]).alias("column"), F.col(cols[0]).cast("double").alias("v"))
    else:
        long = df.select(*by, F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols))))
    return long.where("v is not null").groupBy(*by, "column", "v").agg(F.count("*").alias("n"))


def grouped_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), midpoint: bool = False) -> DataFrame:
    """by, column, q: the quantiles of each of cols in each group, from one ordering of the distinct values; columns
    without values have no row."""
    return level_quantiles(_levels(df, cols, by), [*by, "column"], probs, midpoint)


def with_quantiles(stats: DataFrame, df: DataFrame, by: Sequence[str], names: dict[str, tuple[str, float]]) -> DataFrame:
    """stats (a row for each group) with columns {name: (column of df, probability)}; null where a group has no values."""
    cols = list(dict.fromkeys(c for c, _ in names.values()))
    probs = sorted({p for _, p in names.values()})
    q = grouped_quantiles(df, cols, probs, by)
    pick = [F.max(F.when(F.col("column") == c, F.col("q")[probs.index(p)])).alias(n) for n, (c, p) in names.items()]
    return same(stats, q.groupBy(*by).agg(*pick), by, "left")


def exact_quantiles(df: DataFrame, cols: str | Sequence[str], probs: Sequence[float], midpoint: bool = False) -> list | dict[str, list]:
    """Linear quantiles of the values that aren't null: a list for one column, for several {column: list} from one pass.

    midpoint: the middle of the two values around a place instead. Nulls without values. The driver gets the sums of the
    ranges and then the values at the places asked for.
    """
    names = [cols] if isinstance(cols, str) else list(cols)
    with scratch():
        ordered = _ordered(_levels(df, names), ["column"], ["v"], "n")
        ranges: dict[str, list] = {c: [] for c in names}
        for r in sorted(ordered.groupBy("column", "_part").agg(F.min("_run").alias("start"), F.sum("n").alias("n")).collect(), key=lambda r: r["_part"]):
            ranges[r.column].append((r["_part"], r.start, r.n))
        ends, want = {}, {}
        for c, parts in ranges.items():
            total = sum(n for _, _, n in parts)
            for p in probs if total else ():
                at = p * (total - 1)
                ends[c, p] = math.floor(at + 1e-9), math.ceil(at - 1e-9), at
            for place in {x for (own, _), e in ends.items() if own == c for x in e[:2]}:
                before = 0
                for part, start, n in parts:
                    if place < before + n:
                        want[c, place] = part, start + place - before
                        break
                    before += n
        value = {}
        if want:
            hit = reduce(operator.or_, ((F.col("column") == c) & (F.col("_part") == part) & (F.col("_run") <= run) & (F.col("_run") + F.col("n") > run) for (c, _), (part, run) in want.items()))
            found = ordered.where(hit).select("column", "_part", "_run", "n", "v").collect()
            value = {k: float(r.v) for k, (part, run) in want.items() for r in found if (r.column, r["_part"]) == (k[0], part) and r["_run"] <= run < r["_run"] + r.n}
    out = {}
    for c in names:
        out[c] = []
        for p in probs:
            lo, hi, at = ends.get((c, p), (0, 0, 0.0))
            a, b = value.get((c, lo)), value.get((c, hi))
            out[c].append(None if a is None else a + (b - a) * (0.5 if midpoint and lo < hi else at - lo))
    return out[cols] if isinstance(cols, str) else out


def average_ranks(df: DataFrame, cols: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """df with ranks {column: name} from 1 in each group or in the whole table; equal values share the middle of their
    places, null has none. df is written first, as equal sums of another reading may differ in their last digit."""
    df = kept(df)
    ranks = placed(_levels(df, list(cols), by), [*by, "column"], ["v"], "n").select(*by, "column", "v", (F.col("below") + (F.col("n") + 1) / 2).alias("_rank"))
    for c, name in cols.items():
        own = ranks.where(F.col("column") == c).select(*(F.col(k).alias(f"_by_{k}") for k in by), F.col("v").alias("_v"), F.col("_rank").alias(name))
        on = [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by] + [F.col(c).cast("double") == F.col("_v")]
        df = df.join(own, on, "left").drop("_v", *(f"_by_{k}" for k in by))
    return df


def average_rank(df: DataFrame, col: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    return average_ranks(df, {col: name}, by)

"""Completeness, null runs, regularity and other checks of keyed time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.operators.ranks import running_sum, same


def neighbours(df: DataFrame, col: str, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Previous and next value, and minutes since and until their rows."""
    w = Window.partitionBy(*keys).orderBy(ts)
    gap = lambda a, b: F.timestamp_diff("MINUTE", a, b)
    return df.withColumns(
        {"prev": F.lag(col).over(w), "next": F.lead(col).over(w), "minutes_since": gap(F.lag(ts).over(w), F.col(ts)), "minutes_until": gap(F.col(ts), F.lead(ts).over(w))}
    )


def irregular_intervals(df: DataFrame, keys: Sequence[str], minutes: int, ts: str = "timestamp") -> DataFrame:
    """Rows whose distance from the row before isn't minutes."""
    out = df.withColumn("minutes_since", F.timestamp_diff("MINUTE", F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts)), F.col(ts)))
    return out.where(F.col("minutes_since") != minutes)


def running_total(df: DataFrame, col: str, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """df with the running sum of col by time, null before the first value; a key of any length spreads over tasks."""
    name = f"{col}_running"
    first = df.groupBy(*keys).agg(F.min(F.when(F.col(col).isNotNull(), F.col(ts))).alias("_first"))
    out = same(running_sum(df, keys, [ts], col, name), first, keys)
    return out.withColumn(name, F.when(F.col(ts) >= F.col("_first"), F.col(name))).drop("_first")


def run_ids(df: DataFrame, is_null: Column, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Number (from 0) of the run of equal nullness that a row is in, within keys."""
    w = Window.partitionBy(*keys).orderBy(ts)
    out = df.withColumn("_null", is_null)
    change = F.coalesce((F.col("_null") != F.lag("_null").over(w)).cast("int"), F.lit(0))
    return out.withColumn("_change", change).withColumn("run_id", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def null_runs(df: DataFrame, col: str, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """keys, run_id, gap_start, gap_end, n of each run of nulls."""
    runs = run_ids(df, F.col(col).isNull(), keys, ts).where("_null")
    return runs.groupBy(*keys, "run_id").agg(F.min(ts).alias("gap_start"), F.max(ts).alias("gap_end"), F.count("*").alias("n"))


def completeness(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Share of non-null values of each column, with their mean, least and largest."""
    out = df.groupBy(*keys).agg(*((F.count(x) / F.count("*")).alias(x) for x in cols))
    all_ = [F.col(x) for x in cols]
    return out.withColumns({"mean": sum(all_[1:], all_[0]) / len(all_), "min": F.least(*all_) if len(all_) > 1 else all_[0], "max": F.greatest(*all_) if len(all_) > 1 else all_[0]})


def completeness_long(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return completeness(df, keys, cols).unpivot(list(keys), list(cols), "column", "ratio")


def null_report(df: DataFrame, keys: Sequence[str], cols: Sequence[str], ts: str = "timestamp", least: int = 2) -> DataFrame:
    """For each key and column: nulls, isolated nulls (both neighbours present) and the gaps of at least least rows, in one pass."""
    long = df.select(*keys, ts, *(F.col(x).cast("double").alias(x) for x in cols)).unpivot([*keys, ts], list(cols), "column", "_v")
    runs = run_ids(long, F.col("_v").isNull(), [*keys, "column"], ts)
    edges = Window.partitionBy(*keys, "column").orderBy(ts)
    runs = runs.withColumn("_edge", F.lag(ts).over(edges).isNull() | F.lead(ts).over(edges).isNull())
    one = runs.groupBy(*keys, "column", "run_id", "_null").agg(F.count("*").alias("n"), F.min(ts).alias("gap_start"), F.max(ts).alias("gap_end"), F.max("_edge").alias("edge"))
    is_gap = F.col("_null") & (F.col("n") >= least)
    return one.groupBy(*keys, "column").agg(
        F.sum(F.when(F.col("_null"), F.col("n")).otherwise(0)).alias("nulls"),
        F.count_if(F.col("_null") & (F.col("n") == 1) & ~F.col("edge")).alias("isolated"),
        F.array_sort(F.collect_list(F.when(is_gap, F.struct("gap_start", "gap_end")))).alias("gaps"),
    )


def joined_null_reports(df: DataFrame, keys: Sequence[str], cols: Sequence[str], ts: str = "timestamp", least: int = 2) -> DataFrame:
    """The reports of several columns side by side: a row for each key, <col>_nulls, <col>_isolated and <col>_gaps."""
    long = null_report(df, keys, cols, ts, least)
    of = lambda x, v: F.first(F.when(F.col("column") == x, F.col(v)), ignorenulls=True).alias(f"{x}_{v}")
    return long.groupBy(*keys).agg(*(of(x, v) for x in cols for v in ("nulls", "isolated", "gaps")))


def isolated_nulls(df: DataFrame, col: str, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Nulls with a value on both sides; nulls at an edge of the series don't count."""
    w = Window.partitionBy(*keys).orderBy(ts)
    alone = F.col(col).isNull() & F.lag(col).over(w).isNotNull() & F.lead(col).over(w).isNotNull()
    return df.select(*keys, alone.alias("alone"), F.col(col).isNull().alias("gone")).groupBy(*keys).agg(F.count_if("gone").alias("nulls"), F.count_if("alone").alias("isolated"))


def timestamp_regularity(df: DataFrame, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Number of distinct steps, the most frequent one (the shortest of equals), and whether there is one only."""
    steps = df.withColumn("step", F.timestamp_diff("SECOND", F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts)), F.col(ts))).where(F.col("step").isNotNull())
    counts = steps.groupBy(*keys, "step").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.count("*").alias("n_steps"), F.max_by("step", F.struct("n", -F.col("step"))).alias("modal_step_s"), (F.count("*") == 1).alias("is_regular"))


def share_of_total(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """col as a share of its sum within keys."""
    return df.withColumn(f"{col}_share", F.try_divide(F.col(col), F.nullif(F.sum(col).over(Window.partitionBy(*keys)), F.lit(0.0))))


def carried_values(df: DataFrame, col: str, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Previous and next non-null value with their times, and the value interpolated between them by time."""
    w = Window.partitionBy(*keys).orderBy(ts)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(col).isNotNull(), F.col(ts))
    out = df.withColumns({"prev_value": F.last(col, True).over(back), "prev_time": F.last(at, True).over(back), "next_value": F.first(col, True).over(ahead), "next_time": F.first(at, True).over(ahead)})
    since, until = F.timestamp_diff("SECOND", F.col("prev_time"), F.col(ts)), F.timestamp_diff("SECOND", F.col(ts), F.col("next_time"))
    line = F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * since / F.nullif(since + until, F.lit(0))
    return out.withColumn("interpolated", F.coalesce(F.col(col), line))


def series_bounds(df: DataFrame, col: str, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """df with the first and last value of col, by time, within keys."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({f"first_{col}": F.first(col).over(w), f"last_{col}": F.last(col).over(w)})


def with_totals(df: DataFrame, key: str, sums: Sequence[str], name: str = "TOTAL") -> DataFrame:
    """Sums by key and over all, in one rollup."""
    out = df.rollup(key).agg(*(F.sum(x).alias(x) for x in sums), F.grouping(key).alias("_g"))
    return out.withColumn(key, F.when(F.col("_g") == 1, name).otherwise(F.col(key))).drop("_g")

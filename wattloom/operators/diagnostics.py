"""Correlation, collinearity and outliers from moment sums; only small matrices reach the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.operators.ranks import exact_quantiles


def gram(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Sums of products of cols over the rows without nulls: each task adds up its own p x p matrix, and Spark adds
    those up entry by entry."""
    p = len(cols)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) if b.num_rows else np.zeros((0, p))
            x = x[~np.isnan(x).any(axis=1)]  # nulls come as NaN
            total += x.T @ x
        yield pa.record_batch({"at": pa.array(np.arange(p * p)), "v": pa.array(total.ravel())})

    rows = df.select(*(F.col(x).cast("double") for x in cols)).mapInArrow(own, "at long, v double")
    out = np.zeros(p * p)
    for r in rows.groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r.at] = r.v
    return out.reshape(p, p)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (a, b, r) of Pearson's r, in one aggregation."""
    pairs = [(a, b) for a in cols for b in cols]
    wide = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    long = wide.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "r")


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation of each column given the others and an intercept: the diagonal of the inverse correlation."""
    spark = df.sparkSession
    row = df.dropna(subset=list(cols)).agg(*(F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j)).first()
    r = np.eye(len(cols))
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            r[i, j] = r[j, i] = row[f"{i}_{j}"]
    return spark.createDataFrame([(x, float(v)) for x, v in zip(cols, np.diag(np.linalg.pinv(r)), strict=True)], "column string, vif double")


def eigen_condition(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Eigenvalues (descending) of the Gram matrix, and its condition number on each row."""
    values = np.linalg.eigvalsh(gram(df, cols))[::-1]
    cond = float(np.sqrt(values[0] / values[-1])) if values[-1] > 0 else float("inf")
    return df.sparkSession.createDataFrame([(i, float(v), cond) for i, v in enumerate(values)], "nth int, eigenvalue double, condition double")


def skew_kurtosis(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (column, skewness, excess kurtosis)."""
    wide = df.agg(*(F.array(F.skewness(x), F.kurtosis(x)).alias(x) for x in cols))
    return wide.unpivot([], list(cols), "column", "v").select("column", F.col("v")[0].alias("skewness"), F.col("v")[1].alias("kurtosis"))


def _flagged(df: DataFrame, bounds: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts and percentages of the values outside the bounds <col>_lo, <col>_hi, a row for each column."""
    out = df.crossJoin(F.broadcast(bounds))
    sums = out.agg(*(F.array(F.count_if((F.col(x) < F.col(f"{x}_lo")) | (F.col(x) > F.col(f"{x}_hi"))), F.count(x)).alias(x) for x in cols))
    long = sums.unpivot([], list(cols), "column", "v")
    return long.select("column", F.col("v")[0].alias("outliers"), (F.try_divide(F.col("v")[0], F.col("v")[1]) * 100).alias("percent"))


def outliers_zscore(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> DataFrame:
    stats = df.agg(*(e.alias(n) for x in cols for n, e in ((f"{x}_lo", F.avg(x) - F.stddev_pop(x) * threshold), (f"{x}_hi", F.avg(x) + F.stddev_pop(x) * threshold))))
    return _flagged(df, stats, cols)


def outliers_iqr(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    q = exact_quantiles(df, cols, [0.25, 0.75])
    edges = {n: v for x, (a, b) in q.items() if a is not None for n, v in ((f"{x}_lo", a - (b - a) * k), (f"{x}_hi", b + (b - a) * k))}
    bounds = df.sparkSession.range(1).select(*(F.lit(edges.get(n)).cast("double").alias(n) for x in cols for n in (f"{x}_lo", f"{x}_hi")))
    return _flagged(df, bounds, cols)


def cross_correlation(df: DataFrame, x: str, y: str, lags: int, ts: str = "timestamp") -> DataFrame:
    """corr(x shifted by lag hours, y) of hourly means, for lags -k..k: a join on the shifted hour."""
    from wattloom.functions.columns import plus_minutes, trunc

    hours = df.groupBy(trunc("hour", ts).alias("h")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    shifted = hours.select("x", F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag"), "h").select("lag", "x", plus_minutes("h", (F.col("lag") * 60).cast("int")).alias("h"))
    return shifted.join(hours.select("h", "y"), "h").groupBy("lag").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))

"""Grid series: five minutes to half-hours, generation profiles, factor series by nation, year, month and confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.columns import ceil_minutes, plus_minutes


def resample_30min(df: DataFrame, rates: Sequence[str], amounts: Sequence[str], ts: str = "timestamp", step: int = 5) -> DataFrame:
    """Half-hours stamped at their ends from start-stamped steps: mean of rates, sum of amounts."""
    at = ceil_minutes(plus_minutes(ts, step), 30).alias(ts)
    return df.groupBy(at).agg(*(F.avg(x).alias(x) for x in rates), *(F.sum(x).alias(x) for x in amounts))


def generation_profile(df: DataFrame, sources: Sequence[str], freq: str = "quarter", ts: str = "timestamp") -> DataFrame:
    """Mean of each source by quarter or year, with a label."""
    year = F.year(ts).alias("year")
    if freq == "year":
        return df.groupBy(year).agg(*(F.avg(x).alias(x) for x in sources)).withColumn("label", F.col("year").cast("string"))
    out = df.groupBy(year, F.quarter(ts).alias("quarter")).agg(*(F.avg(x).alias(x) for x in sources))
    return out.withColumn("label", F.concat(F.col("year").cast("string"), F.lit(" Q"), F.col("quarter").cast("string")))


def nationalise(df: DataFrame, factors: Sequence[str], weight: str | None = None, total: str | None = None, first: Sequence[str] = (), order: str = "city", ts: str = "timestamp") -> DataFrame:
    """One row for each time: weighted or plain mean of factors, sum of total, and of other columns the value of the
    first row by order."""
    mean = lambda x: F.sum(F.col(x) * F.col(weight)) / F.sum(F.when(F.col(x).isNotNull(), F.col(weight))) if weight else F.avg(x)
    sums = [F.sum(total).alias(total)] if total else []
    return df.groupBy(ts).agg(*(mean(x).alias(x) for x in factors), *sums, *(F.min_by(x, order).alias(x) for x in first))


def yearly_means(df: DataFrame, cols: Sequence[str], ts: str = "timestamp") -> DataFrame:
    return df.groupBy(F.year(ts).alias("year")).agg(*(F.avg(x).alias(x) for x in cols))


def monthly_means(df: DataFrame, cols: Sequence[str], ts: str = "timestamp") -> DataFrame:
    return df.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month")).agg(*(F.avg(x).alias(x) for x in cols))


def _period(freq: str, ts: str) -> list:
    return {"year": [F.year(ts).alias("year")], "month": [F.year(ts).alias("year"), F.month(ts).alias("month")], "hour_year": [F.year(ts).alias("year"), F.hour(ts).alias("hour")]}[freq]


def confidence_weighted(df: DataFrame, weight: str, freq: str = "year", label: str = "confidence", levels: Sequence[str] = ("low", "medium", "high"), ts: str = "timestamp") -> DataFrame:
    """Summed weight of each label, and its share of all."""
    out = df.groupBy(*_period(freq, ts)).agg(F.sum(weight).alias("total"), *(F.sum(F.when(F.col(label) == x, F.col(weight)).otherwise(0.0)).alias(x) for x in levels))
    return out.withColumns({f"{x}_share": F.try_divide(F.col(x), F.nullif(F.col("total"), F.lit(0.0))) for x in levels})


def confidence_counts(df: DataFrame, freq: str = "year", label: str = "confidence", levels: Sequence[str] = ("low", "medium", "high"), ts: str = "timestamp") -> DataFrame:
    return df.groupBy(*_period(freq, ts)).agg(*(F.count_if(F.col(label) == x).alias(x) for x in levels))


def low_confidence_share(df: DataFrame, demand: str, label: str = "confidence", ts: str = "timestamp") -> DataFrame:
    out = df.groupBy(*_period("month", ts)).agg(F.sum(F.when(F.col(label) == "low", F.col(demand)).otherwise(0.0)).alias("low"), F.sum(demand).alias("demand"))
    return out.withColumn("low_share", F.try_divide("low", F.nullif(F.col("demand"), F.lit(0.0))))


def calibration_deltas(df: DataFrame, raw: str = "ME", calibrated: str = "ME_cal") -> DataFrame:
    return df.withColumns({"delta": F.col(calibrated) - F.col(raw), "ratio": F.try_divide(F.col(calibrated), F.nullif(F.col(raw), F.lit(0.0)))})


def mef_aef_gap(df: DataFrame, mef: str = "mef", aef: str = "aef") -> DataFrame:
    return df.withColumns({"gap": F.col(mef) - F.col(aef), "gap_ratio": F.try_divide(F.col(mef) - F.col(aef), F.nullif(F.col(aef), F.lit(0.0)))})

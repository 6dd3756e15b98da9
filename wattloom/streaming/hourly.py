"""Incremental form of the hourly aggregation, for a feed of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """Sums and means by customer, city and hour of a stream with event time date; an hour closes when late has passed."""
    return (
        readings.withColumn("date", F.col("date").cast("timestamp")).withWatermark("date", late)
        .groupBy("ca_id", "city", F.window("date", "1 hour").alias("w"))
        .agg(F.sum("value").alias("total"), F.avg("value").alias("mean_value"))
        .select("ca_id", "city", F.col("w.start").alias("hour"), "total", "mean_value")
    )

"""Sources, sinks and the stream, on temporary folders."""

import datetime as dt

from pyspark.sql import functions as F

from wattloom.operators.usage import hourly_aggregate, per_file_stats
from wattloom.sources import io
from wattloom.streaming.hourly import hourly_stream


def readings(spark):
    rows = [("1", dt.datetime(2024, 1, 1, 5, 10), 1.0, "New Delhi"), ("1", dt.datetime(2024, 4, 1, 5, 40), 2.0, "New Delhi"), ("2", dt.datetime(2024, 1, 1, 5, 50), 4.0, "Agra")]
    return spark.createDataFrame(rows, io.READINGS)


def test_standardise(spark):
    raw = spark.createDataFrame([(7, "2024-01-01 00:30:00", "1.5", "A"), (8, "bad", "x", None)], "ca_id long, date string, value string, city string")
    a, b = io.standardise_readings(raw).collect()
    assert (a.ca_id, a.date, a.value) == ("7", dt.datetime(2024, 1, 1, 0, 30), 1.5) and (b.date, b.value) == (None, None)


def test_partitioned_round_trips(spark, tmp_path):
    df = readings(spark)
    io.partition_by_city(df, str(tmp_path / "city"))
    io.partition_by_quarter(df, str(tmp_path / "quarter"))
    io.partition_by_city_week(df, str(tmp_path / "week"))
    assert sorted(p.name for p in (tmp_path / "city").iterdir() if p.is_dir()) == ["city_key=agra", "city_key=new_delhi"]
    for x in ("city", "quarter", "week"):
        assert io.read_table(spark, str(tmp_path / x)).count() == 3
    assert io.read_table(spark, str(tmp_path / "quarter")).where("quarter = 'Q2'").count() == 1
    assert per_file_stats(io.read_table(spark, str(tmp_path / "city"))).count() >= 2


def test_csv_and_names(spark, tmp_path):
    io.write_csv(readings(spark).withColumn("date", F.col("date").cast("string")), str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c")).count() == 3
    readings(spark).coalesce(1).write.parquet(str(tmp_path / "r" / "p1__greedy__moves__r3"))
    got = io.combine_groups(spark, str(tmp_path / "r")).first()
    assert (got.policy, got.solver, got.kind, got["rank"]) == ("p1", "greedy", "moves", "3")


def test_consolidate_and_align(spark):
    df = spark.createDataFrame([("a", "m", 1, 10), ("a", "m", 2, 20), ("b", "m", 1, 30)], "case string, kind string, run_ts int, v int")
    assert sorted(r.v for r in io.consolidate_runs(df).collect()) == [20, 30]
    out = io.align_for_concat([spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2.5, "s")], "x double, y string")])
    assert dict(out.dtypes) == {"x": "double", "y": "string"} and out.count() == 2


def test_predicates_and_years(spark):
    p = io.month_predicates("date", 2024)
    assert len(p) == 12 and p[-1] == "date >= '2024-12-01 00:00:00' AND date < '2025-01-01 00:00:00'"
    assert [r.year for r in io.sampled_years(readings(spark), fraction=1.0).collect()] == [2024]


def test_stream_equals_batch(spark, tmp_path):
    readings(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(io.READINGS).parquet(str(tmp_path / "in"))
    q = hourly_stream(stream).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    try:
        q.processAllAvailable()
        got = {(r.ca_id, r.total) for r in spark.table("hours").collect()}
    finally:
        q.stop()
    assert got == {(r.ca_id, r.total) for r in hourly_aggregate(readings(spark)).collect()}


def test_jdbc_reads_one_year_by_months(spark, tmp_path):
    """The embedded database that comes with Spark stands for any other."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(1, "2023-12-31 23:59:59"), (2, "2024-01-01 00:00:00"), (3, "2024-06-15 12:00:00"), (4, "2024-12-31 23:30:00"), (5, "2025-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "ID int, at string").select("ID", F.to_timestamp("at").alias("READ_AT"))
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df.write.jdbc(url, "readings", properties=driver)
    assert {r[0] for r in io.read_jdbc(spark, url, "readings", properties=driver).collect()} == {1, 2, 3, 4, 5}
    year = io.read_jdbc(spark, url, "readings", ts="READ_AT", year=2024, properties=driver)
    assert year.rdd.getNumPartitions() == 12 and {r[0] for r in year.collect()} == {2, 3, 4}

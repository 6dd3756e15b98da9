"""Column functions and input readers on small hand-made frames."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from wattloom.functions import columns as C
from wattloom.functions.wkb import points_from_wkb


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_time_columns(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-12-30 23:45:10' AS date")
    r = df.select(
        C.iso_year("date").alias("y"), C.iso_week("date").alias("w"), C.iso_weekday("date").alias("d"), C.slot("date").alias("s"), C.quarter_label("date").alias("q"),
        C.days_in_month("date").alias("n"), C.week_start("date").alias("m"), C.ceil_minutes("date", 30).alias("c"), C.floor_minutes("date", 30).alias("f"), C.iso_week_label("date").alias("l"),
    ).first()
    assert (r.y, r.w, r.d, r.s, r.q, r.n, r.m, r.l) == (2025, 1, 1, 47, "Q4", 31, dt.date(2024, 12, 30), "2025-W01")
    assert (r.f, r.c) == (dt.datetime(2024, 12, 30, 23, 30), dt.datetime(2024, 12, 31))


def test_zones(spark):
    r = spark.sql("SELECT timestamp_ntz'2024-01-01 05:30:00' AS t").select(C.localise("t", "Asia/Kolkata").alias("u")).first()
    assert r.u == dt.datetime(2024, 1, 1)


def test_cardinals_and_wind(spark):
    df = one(spark, d=359.0, u=0.0, v=-1.0)
    s, a = C.wind_from_uv("u", "v")
    r = df.select(C.degrees_to_cardinal("d", 8).alias("c"), C.degrees_to_cardinal("d", 16).alias("k"), s.alias("s"), a.alias("a")).first()
    assert (r.c, r.k, r.s, r.a) == ("N", "N", 1.0, 0.0)  # a wind to the south comes from the north


def test_shares_and_logs(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.0, 0.0)], ["p", "t"])
    assert [r.p_share for r in C.generation_shares(df, ["p"], "t").collect()] == [25.0, None]
    r = one(spark, x=0.0, p=1.0).select(C.zero_inflated_log("x")[0].alias("f"), C.bounded_logit("p").alias("l")).first()
    assert r.f == 0 and r.l == pytest.approx(9.21, abs=0.01)


def test_units_and_emissions(spark):
    r = one(spark, x=1.0).select(C.joules_to_kwh(F.lit(3.6e6)).alias("k"), C.me_grams_per_kwh("x").alias("g"), C.mw_to_kwh("x").alias("m"), C.mph_to_mps("x").alias("s")).first()
    assert (r.k, r.g, r.m, r.s) == (1.0, 2000.0, 500.0, 0.44704)
    with pytest.raises(ValueError):
        C.fuel_emissions("x", "x", "x", "x", 15)


def test_fitted_columns(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(11)], ["x", "c"])
    assert C.standardise_fit(df, ["x"], robust=True)["x"] == (5.0, 5.0)
    assert C.winsorize_fit(df, ["x"], 0.1, 0.9)["x"] == (1.0, 9.0)
    params = C.standardise_fit(df, ["x"])
    back = C.standardise(C.standardise(df, params), params, inverse=True).collect()
    assert [round(r.x, 9) for r in back] == [float(i) for i in range(11)]
    hot = C.onehot(spark.createDataFrame([("b",), ("z",), (None,)], "c string"), C.onehot_fit(df, ["c"]))
    assert [r.c_b for r in hot.collect()] == [1, 0, 0]
    assert C.standardise_fit(spark.createDataFrame([(1.0,), (1.0,)], ["x"]), ["x"])["x"] == (1.0, 1.0)


def test_names(spark):
    df = one(spark, Customer_ID=1, value=2.0)
    assert C.resolve_column(df, "customer id") == "Customer_ID"
    assert C.canonical_columns(df, {"ca_id": ["id", "Customer_ID"]}).columns == ["ca_id", "value"]
    with pytest.raises(KeyError):
        C.require_columns(df, ["nothing"])
    with pytest.raises(KeyError):
        C.drop_columns(df, ["nothing"], errors="raise")


def test_peak_flags(spark):
    peaks = spark.createDataFrame([(1, 8, "morning"), (1, 19, "evening")], "dow int, hour int, peak string")
    df = spark.sql("SELECT explode(array(timestamp_ntz'2024-01-01 08:10:00', timestamp_ntz'2024-01-01 12:00:00')) AS t")
    assert [(r.morning_peak, r.evening_peak, r.off_peak) for r in C.peak_flags(df, "t", peaks).orderBy("t").collect()] == [(1, 0, 0), (0, 0, 1)]


def test_points_from_wkb(spark):
    little, big = struct.pack("<BIdd", 1, 1, 73.5, 19.25).hex(), struct.pack(">BIdd", 0, 1, 73.5, 19.25).hex()
    srid = struct.pack("<BIIdd", 1, 0x20000001, 4326, 73.5, 19.25).hex()
    df = spark.createDataFrame([(little,), (big,), (srid,), ("zz",), ("01",), (None,), ("",)], "p string")
    assert [(r.lon, r.lat) for r in points_from_wkb(df, "p").collect()] == [(73.5, 19.25)] * 3 + [(None, None)] * 4


def test_radius(spark):
    df = spark.createDataFrame([(19.0, 73.0), (19.5, 73.0), (None, 73.0)], "lat double, lon double")
    assert C.filter_by_radius(df, "lat", "lon", (19.0, 73.0), 10.0).count() == 1
    km = df.limit(2).select(C.haversine_km("lat", "lon", F.lit(20.0), F.lit(73.0)).alias("k")).collect()
    assert km[0].k == pytest.approx(111.195, abs=0.01)

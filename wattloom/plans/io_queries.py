"""Queries of sources and sinks, names and units, and of the steps of a model run."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions import columns as C
from wattloom.functions.wkb import points_from_wkb
from wattloom.operators import mef as M
from wattloom.operators import quality as Q
from wattloom.operators import shift as S
from wattloom.plans.fixtures import Inputs, rounded, sql
from wattloom.sources import io


def _q(f, digits: int = 6):
    return lambda spark, d: rounded(f(Inputs(spark, d)), digits)


def _path(i: Inputs, name: str) -> str:
    return f"{io.shared_folder(i.spark)}/wattloom/{name}-{uuid.uuid4().hex}"


def _text_readings(i: Inputs) -> DataFrame:
    """Readings as text, some of which can't be read."""
    odd = F.pmod("ca_id", F.lit(7)) == 0
    r = i.readings
    return r.select(F.col("ca_id").cast("string").alias("ca_id"), F.when(odd, "no time").otherwise(F.date_format("date", "yyyy-MM-dd HH:mm:ss")).alias("date"), F.when(odd, "?").otherwise(F.col("value").cast("string")).alias("value"), "city")


def _csv(i: Inputs) -> DataFrame:
    path = _path(i, "report")
    io.write_csv(i.table("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").cast("decimal(20,2)").alias("total")), path)
    return io.read_csv(i.spark, path, "o_orderpriority string, n long, total double")


def _inferred(i: Inputs) -> DataFrame:
    path = _path(i, "report")
    io.write_csv(i.table("nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    out = io.read_csv(i.spark, path)
    return out.select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))


def _parted(i: Inputs, write, by: list[str]) -> DataFrame:
    path = _path(i, "parts")
    write(i.readings, path)
    out = io.read_table(i.spark, path)
    return out.groupBy(*(F.col(c).cast("string").alias(c) for c in by)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def _runs(i: Inputs) -> DataFrame:
    o = i.table("orders")
    return o.select("o_orderkey", F.trunc("o_orderdate", "month").alias("run_ts"), F.col("o_orderpriority").alias("case"), F.col("o_orderstatus").alias("kind"))


def _combined(i: Inputs) -> DataFrame:
    path = _path(i, "results")
    for n, status in enumerate(("F", "O")):
        io.write_parquet(i.table("orders").where(F.col("o_orderstatus") == status).select("o_orderkey", "o_totalprice"), f"{path}/policy_{n}__greedy__moves__r{n}/x.parquet")
    return io.combine_groups(i.spark, path).drop("file")


def _exported(i: Inputs) -> DataFrame:
    path = _path(i, "factors")
    io.export_me(i.factors.withColumn("split", F.when(F.month("timestamp") <= 6, "train").otherwise("test")), path)
    return io.read_table(i.spark, path).withColumn("split", F.col("split").cast("string"))


def _with_me(df: DataFrame) -> DataFrame:
    data = df.withColumn("q2", F.col("q") * F.col("q"))
    return M.groupwise_me(data, M.groupwise_ols(data, "y", ["q", "q2"], ["g"]), "q", ["g"], "q", "q2")


def _hex_points(i: Inputs) -> DataFrame:
    """Points as hexadecimal text: little-endian, every third with a reference system, every seventh cut short."""

    @F.pandas_udf("string")
    def text(k: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.Series:
        from struct import pack

        raw = [pack("<BIIdd", 1, 0x20000001, 4326, x, y) if n % 3 == 0 else pack("<BIdd", 1, 1, x, y) for n, x, y in zip(k, lon, lat, strict=True)]
        return pd.Series([r.hex()[: 20 if n % 7 == 0 else None] for n, r in zip(k, raw, strict=True)])

    p = i.customer_points
    return points_from_wkb(p.select("ca_id", text("ca_id", "lon", "lat").alias("wkb")), "wkb").select("ca_id", "lon", "lat")


def _fuel(i: Inputs) -> DataFrame:
    thermal, gas = C.fuel_emissions("thermal", "gas", F.lit(0.9), F.lit(0.4), 5)
    return i.grid_5min.select("timestamp", thermal.alias("thermal_t"), gas.alias("gas_t"))


def _units(i: Inputs) -> DataFrame:
    return i.factors.select("timestamp", C.me_grams_per_kwh(F.col("mef") / 1e5).alias("grams_per_kwh"), C.mw_to_kwh("aef").alias("kwh"))


def _named(i: Inputs) -> DataFrame:
    """Names put right, the one asked for found, and only those needed kept."""
    df = C.canonical_columns(i.table("customer"), {"ca_id": ("id", "c_custkey"), "city": ("town", "c_mktsegment")})
    df = C.require_columns(df, ["ca_id", "city"]).withColumnRenamed(C.resolve_column(df, "C Acct-Bal"), "balance")
    return C.keep_columns(C.drop_columns(df, ["c_comment", "no such column"]), ["ca_id", "city", "balance"])


def _aligned(i: Inputs) -> DataFrame:
    a = i.table("orders").select(F.col("o_orderkey").cast("int").alias("key"), F.col("o_totalprice").cast("float").alias("amount"))
    b = i.table("lineitem").select(F.col("l_orderkey").cast("long").alias("key"), F.col("l_quantity").cast("double").alias("amount"), F.col("l_returnflag").alias("flag"))
    out = io.align_for_concat([a.withColumn("amount", F.round("amount", 0)), b])
    return out.groupBy("flag").agg(F.count("*").alias("n"), F.sum("key").alias("keys"), F.sum(F.col("amount").cast("double")).alias("amount"))


def _prepared(i: Inputs) -> DataFrame:
    steps = M.Preprocess(winsorize=("y",), log1p=("q",), polynomial=("x", 2), standardise=("y",), onehot=("s",)).fit(i.model_rows)
    out = steps.apply(i.model_rows)
    return out.groupBy("g").agg(*(F.avg(c).alias(f"mean_{c}") for c in ("y", "q", "x_1", "x_2", "s_O")), F.count("*").alias("n"))


def _evaluated(i: Inputs) -> DataFrame:
    r = i.model_rows.groupBy(F.col("g").alias("city"), F.col("t").alias("timestamp")).agg(F.avg("q").alias("q"), (F.avg("y") / 1000).alias("y"), (F.avg("x") * 10).alias("ME"))
    out = M.evaluate_model(r.withColumn("p", 1.5 * F.col("q")), "y", "p", "q", "ME", ["city"], max_minutes=2880)
    ramps = out["ramps"].select(F.col("city").alias("name"), F.lit("ramps").alias("part"), F.col("n_pairs").alias("n"), "rmse")
    groups = out["by_group"].select(F.col("city").alias("name"), F.lit("group").alias("part"), "n", "rmse")
    return ramps.unionByName(groups).unionByName(out["overall"].select(F.lit("all").alias("name"), F.lit("overall").alias("part"), "n", "rmse"))


QUERIES = {
    "a1_read_table": _q(lambda i: io.read_table(i.spark, f"{i.sf_dir}/events.parquet", i.table("events").select("user_id", "value", "event_type").schema).where("value > 10").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))),
    "a2_month_predicates": _q(lambda i: (lambda o: o.where(" OR ".join(f"({p})" for p in io.month_predicates("o_orderdate", 1995))).groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n")))(i.table("orders"))),
    "a3_sampled_years": _q(lambda i: io.sampled_years(i.readings, fraction=0.1)),
    "a4_read_csv": _q(_inferred),
    "a5_standardise_readings": _q(lambda i: io.standardise_readings(_text_readings(i))),
    "a6_write_parquet": _q(lambda i: (lambda p: (io.write_parquet(i.factors, p), io.read_table(i.spark, p))[1])(_path(i, "table"))),
    "a7_write_csv": _q(_csv),
    "a8_partition_by_city": _q(lambda i: _parted(i, io.partition_by_city, ["city_key"])),
    "a9_partition_by_quarter": _q(lambda i: _parted(i, io.partition_by_quarter, ["year", "quarter"])),
    "a10_partition_by_city_week": _q(lambda i: _parted(i, io.partition_by_city_week, ["city_key", "week_start"])),
    "a11_consolidate_runs": _q(lambda i: io.consolidate_runs(_runs(i)).select("o_orderkey", "case", "kind")),
    "a12_combine_groups": _q(_combined),
    "a13_export_me": _q(_exported),
    "a14_export_full": _q(lambda i: io.export_full(i.model_rows, _with_me, _path(i, "full"), ["g", "q", "ME"]).groupBy("g").agg(F.count("*").alias("n"), F.avg("ME").alias("mean_me")), 3),
    "b10_weekday_name": _q(lambda i: i.readings.groupBy(C.weekday_name("date").alias("name")).agg(F.count("*").alias("n"))),
    "b28_b29_names": _q(_named),
    "b31_me_units": _q(_units),
    "b33_points_from_wkb": _q(_hex_points),
    "b37_slots_of_hours": _q(lambda i: S.candidate_moves(i.shift_days, C.slots_of_hours(1.5)).groupBy(F.abs(F.col("s") - F.col("t")).alias("distance")).agg(F.count("*").alias("n"))),
    "b38_fuel_emissions": _q(_fuel),
    "d23_joined_null_reports": _q(lambda i: (lambda r: r.select("location", *((F.size(c).alias(c) if c.endswith("gaps") else F.col(c)) for c in r.columns if c != "location")))(Q.joined_null_reports(i.weather_hourly, ["location"], ["temperature", "precipitation"]))),
    "f4_sample_rows": _q(lambda i: io.sample_rows(i.readings, 10).join(i.readings.select("ca_id", "date", "value").distinct(), ["ca_id", "date", "value"], "left_semi").agg(F.count("*").alias("n"))),
    "g3_align_for_concat": _q(_aligned, 2),
    "j18_preprocess": _q(_prepared, 4),
    "j19_evaluate_model": _q(_evaluated, 4),
}

_KEY = "regexp_replace(lower(city), '[^a-z0-9_-]', '_', 'g')"
_OLS2 = """, c AS (SELECT g, count(*) AS n, covar_pop(q, q) AS a, covar_pop(q, q * q) AS b, covar_pop(q * q, q * q) AS d, covar_pop(q, y) AS u, covar_pop(q * q, y) AS v, avg(q) AS m FROM model_rows GROUP BY g)"""
_GAPS = """, w AS (SELECT location, timestamp, c, CASE WHEN c = 'temperature' THEN temperature ELSE precipitation END AS v FROM weather_hourly, (SELECT unnest(['temperature', 'precipitation']) AS c)),
r AS (SELECT *, v IS NULL AS gone, row_number() OVER (PARTITION BY location, c ORDER BY timestamp) - row_number() OVER (PARTITION BY location, c, v IS NULL ORDER BY timestamp) AS run, lag(timestamp) OVER o IS NULL OR lead(timestamp) OVER o IS NULL AS edge FROM w WINDOW o AS (PARTITION BY location, c ORDER BY timestamp)),
u AS (SELECT location, c, run, count(*) AS n, bool_or(edge) AS edge FROM r WHERE gone GROUP BY ALL),
t AS (SELECT location, c, sum(n)::BIGINT AS nulls, count(*) FILTER (n = 1 AND NOT edge) AS isolated, count(*) FILTER (n >= 2)::INT AS gaps FROM u GROUP BY ALL)"""

SQL = {
    "a1_read_table": "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE value > 10 GROUP BY event_type",
    "a2_month_predicates": "SELECT month(o_orderdate)::INT AS month, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY ALL",
    "a3_sampled_years": "SELECT DISTINCT year(ts)::INT AS year FROM events",
    "a4_read_csv": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation",
    "a5_standardise_readings": sql("SELECT ca_id::VARCHAR AS ca_id, CASE WHEN ca_id % 7 <> 0 THEN date_trunc('second', date) END AS date, CASE WHEN ca_id % 7 <> 0 THEN round(value, 6) END AS value, city FROM readings", "readings"),
    "a6_write_parquet": sql("SELECT timestamp, round(aef, 6) AS aef, round(mef, 6) AS mef FROM factors", "factors"),
    "a7_write_csv": "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL",
    "a8_partition_by_city": sql(f"SELECT {_KEY} AS city_key, count(*) AS n, round(sum(value), 6) AS total FROM readings GROUP BY ALL", "readings"),
    "a9_partition_by_quarter": sql("SELECT year(date)::VARCHAR AS year, 'Q' || quarter(date) AS quarter, count(*) AS n, round(sum(value), 6) AS total FROM readings GROUP BY ALL", "readings"),
    "a10_partition_by_city_week": sql(f"SELECT {_KEY} AS city_key, date_trunc('week', date)::DATE::VARCHAR AS week_start, count(*) AS n, round(sum(value), 6) AS total FROM readings GROUP BY ALL", "readings"),
    "a11_consolidate_runs": "WITH o AS (SELECT o_orderkey, date_trunc('month', o_orderdate) AS r, o_orderpriority AS case_, o_orderstatus AS kind FROM orders), m AS (SELECT case_, kind, max(r) AS r FROM o GROUP BY ALL) SELECT o_orderkey, case_ AS \"case\", kind FROM o JOIN m USING (case_, kind, r)",
    "a12_combine_groups": "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, 'policy_' || n AS policy, 'greedy' AS solver, 'moves' AS kind, n AS rank FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' END AS n FROM orders) WHERE n IS NOT NULL",
    "a13_export_me": sql("SELECT timestamp, round(aef, 6) AS aef, round(mef, 6) AS mef, CASE WHEN month(timestamp) <= 6 THEN 'train' ELSE 'test' END AS split FROM factors", "factors"),
    "a14_export_full": sql(_OLS2 + " SELECT g, n, round((u * d - v * b) / (a * d - b * b) + 2 * (v * a - u * b) / (a * d - b * b) * m, 3) AS mean_me FROM c", "model_rows"),
    "b10_weekday_name": sql("SELECT dayname(date)[1:3] AS name, count(*) AS n FROM readings GROUP BY ALL", "readings"),
    "b28_b29_names": "SELECT c_custkey AS ca_id, c_mktsegment AS city, round(c_acctbal, 6) AS balance FROM customer",
    "b31_me_units": sql("SELECT timestamp, round(mef / 100000 / 0.5::DOUBLE * 1000, 6) AS grams_per_kwh, round(aef * 0.5::DOUBLE * 1000, 6) AS kwh FROM factors", "factors"),
    "b33_points_from_wkb": sql("SELECT ca_id, CASE WHEN ca_id % 7 <> 0 THEN round(lon, 6) END AS lon, CASE WHEN ca_id % 7 <> 0 THEN round(lat, 6) END AS lat FROM customer_points", "customer_points"),
    "b37_slots_of_hours": sql("SELECT abs(s.slot - t.slot)::INT AS distance, count(*) AS n FROM (SELECT *, unnest(range(slot - 3, slot + 4))::INT AS at FROM shift_input WHERE value > 0) t JOIN shift_input s ON s.ca_id = t.ca_id AND s.city = t.city AND s.day = t.day AND s.slot = t.at AND s.mef < t.mef GROUP BY ALL", "shift_input"),
    "b38_fuel_emissions": sql("SELECT timestamp, round(thermal * 0.9::DOUBLE * 5 / 60, 6) AS thermal_t, round(gas * 0.4::DOUBLE * 5 / 60, 6) AS gas_t FROM grid_5min", "grid_5min"),
    "d23_joined_null_reports": sql(_GAPS + ", k AS (SELECT DISTINCT location FROM weather_hourly) SELECT k.location, " + ", ".join(f"coalesce({x}.{v}, 0) AS {c}_{v}" for x, c in (("x", "temperature"), ("y", "precipitation")) for v in ("nulls", "isolated", "gaps")) + " FROM k LEFT JOIN t x ON x.location = k.location AND x.c = 'temperature' LEFT JOIN t y ON y.location = k.location AND y.c = 'precipitation'", "weather_hourly"),
    "f4_sample_rows": "SELECT least(10, count(*)) AS n FROM events",
    "g3_align_for_concat": "SELECT flag, count(*) AS n, sum(key)::BIGINT AS keys, round(sum(amount), 2) AS amount FROM (SELECT o_orderkey AS key, round(o_totalprice::FLOAT, 0)::DOUBLE AS amount, NULL AS flag FROM orders UNION ALL SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem) GROUP BY flag",
    "j18_preprocess": sql(", b AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM model_rows), z AS (SELECT g, s, x, ln(1 + q) AS q, least(greatest(y, lo), hi) AS y FROM model_rows, b), m AS (SELECT avg(y) AS m, stddev_pop(y) AS d FROM z) SELECT g, round(avg((y - m) / d), 4) + 0.0 AS mean_y, round(avg(q), 4) AS mean_q, round(avg(x), 4) AS mean_x_1, round(avg(x * x), 4) AS mean_x_2, round(avg((s = 'O')::INT), 4) AS \"mean_s_O\", count(*) AS n FROM z, m GROUP BY g", "model_rows"),
    "j19_evaluate_model": sql(""", ra AS (SELECT g AS city, t AS timestamp, avg(q) AS q, avg(y) / 1000 AS y, avg(x) * 10 AS ME, 1.5 * avg(q) AS p FROM model_rows GROUP BY ALL),
rd AS (SELECT city, epoch(timestamp - lag(timestamp) OVER w) / 60 AS minutes, q - lag(q) OVER w AS dq, y - lag(y) OVER w AS dy, (ME + lag(ME) OVER w) / 2 AS m FROM ra WINDOW w AS (PARTITION BY city ORDER BY timestamp)),
rp AS (SELECT city, dy / dq - m AS e FROM rd WHERE minutes > 0 AND minutes <= 2880 AND abs(dq) >= 1e-12)
SELECT city AS name, 'ramps' AS part, count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse FROM rp GROUP BY city UNION ALL SELECT 'ALL', 'ramps', count(*), round(sqrt(avg(e * e)), 4) FROM rp
UNION ALL SELECT city, 'group', count(*), round(sqrt(avg((y - p) * (y - p))), 4) FROM ra GROUP BY city UNION ALL SELECT 'all', 'overall', count(*), round(sqrt(avg((y - p) * (y - p))), 4) FROM ra""", "model_rows"),
}

"""Further queries: simple joins, windows, sets, orders and feature columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions import columns as C
from wattloom.operators import joins as J
from wattloom.operators import mef as M
from wattloom.operators import quality as Q
from wattloom.operators import shift as S
from wattloom.plans.fixtures import Inputs, rounded, sql
from wattloom.plans.model_queries import _CAND, greedy_sql
from wattloom.sources import io


def _q(f, digits: int = 6):
    return lambda spark, d: rounded(f(Inputs(spark, d)), digits)


def _half(i: Inputs):
    return i.readings_30min


def _customers(i: Inputs):
    return i.table("customer").select(F.col("c_custkey").alias("ca_id"), F.col("c_nationkey").alias("location_id"))


def _daily(i: Inputs):
    return i.readings.groupBy("city", F.to_date("date").alias("day")).agg(F.sum("value").alias("kwh"))


QUERIES = {
    "b14_analysis_features": _q(lambda i: C.analysis_features(i.grid_5min.select("timestamp", "total", "tons_co2"), "timestamp", "total", "tons_co2")),
    "b17_wind_to_cyclic": _q(lambda i: C.wind_to_cyclic(i.readings.select("ca_id", "date", F.col("value").alias("wind")), "wind")),
    "b21_peak_flags": _q(lambda i: C.peak_flags(i.readings.select("ca_id", "date"), "date", i.spark.createDataFrame([(d, h, p) for d in range(1, 6) for h, p in ((7, "morning"), (8, "morning"), (18, "evening"))], "dow int, hour int, peak string"))),
    "b22_logs": _q(lambda i: i.readings.select("ca_id", "date", C.log_transform("value").alias("ln"), C.log1p_clamped(F.col("value") - 50).alias("ln1p"))),
    "b24_bounded_logit": _q(lambda i: i.table("lineitem").select("l_orderkey", "l_linenumber", C.bounded_logit("l_discount").alias("logit"))),
    "b36_classify_move": _q(lambda i: S.moves_table(S.share_capped_greedy(i.shift_days, 4)).groupBy(C.classify_move("average_emissions_delta_grams_co2").alias("category"), "shift_direction").agg(F.count("*").alias("n"))),
    "c2_join_models": _q(lambda i: J.join_models(i.factors, i.factors.where("aef > 200000"), ["timestamp"], "_other")),
    "c3_join_location": _q(lambda i: J.join_location(i.readings, _customers(i))),
    "c4_join_time_location": _q(lambda i: J.join_time_location(J.join_location(_half(i), _customers(i)), _half(i).groupBy("date").agg(F.avg("value").alias("factor")).withColumn("location_id", F.lit(3)))),
    "c6_stack_grid_weather": _q(lambda i: J.stack_grid_weather(i.weather_hourly, i.grid_5min.select("timestamp", "thermal"))),
    "e8_share_of_total": _q(lambda i: Q.share_of_total(_daily(i), "kwh", ["day"])),
    "e9_carried_values": _q(lambda i: Q.carried_values(i.weather_hourly.select("timestamp", "location", "temperature"), "temperature", ["location"])),
    "e11_series_bounds": _q(lambda i: Q.series_bounds(_daily(i), "kwh", ["city"], "day")),
    "f1_mixed_order": _q(lambda i: _daily(i).orderBy("day", F.desc("kwh"), F.asc_nulls_last("city"))),
    "f2_top_times": _q(lambda i: io.top_k(_half(i).groupBy("date").agg(F.count("*").alias("n")), [F.desc("n"), "date"], 4)),
    "g1_union": _q(lambda i: io.align_for_concat([i.factors.select("timestamp", "aef"), i.factors.select("timestamp", F.col("mef").cast("long").alias("aef"), "mef")])),
    "g2_totals": _q(lambda i: Q.with_totals(i.readings, "city", ["value"])),
    "g6_membership": _q(lambda i: i.readings.where(F.col("city").isin("click", "view")).groupBy("ca_id").agg(F.count("*").alias("n"))),
    "j14_me_for_split": _q(lambda i: M.me_for_split(i.factors.withColumnRenamed("mef", "ME"), ["timestamp"], "train")),
    "j17_config_hash": _q(lambda i: M.hash_column(i.table("nation").select("n_nationkey", "n_name"), ["n_nationkey", "n_name"])),
    "k11_preset_one": _q(lambda i: S.shift_load(i.shift_used, S.PRESETS[1], factors=i.shift_factors).groupBy("city").agg(F.count("*").alias("moves"), F.sum("q").alias("kwh"))),
}

SQL = {
    "b14_analysis_features": sql("SELECT timestamp, round(total, 6) AS total, round(tons_co2, 6) AS tons_co2, strftime(timestamp, '%H-%M') AS time_id, round(total * total, 6) AS q_squared, round(ln(total + 1e-6), 6) AS log_q, round(ln(total + 1e-6) * ln(total + 1e-6), 6) AS log_q_squared, round(ln(tons_co2 + 1e-6), 6) AS log_co2 FROM grid_5min", "grid_5min"),
    "b17_wind_to_cyclic": sql("SELECT ca_id, date, round(value, 6) AS wind, round(sin(radians(270 - value)), 6) + 0.0 AS wind_sin, round(cos(radians(270 - value)), 6) + 0.0 AS wind_cos FROM readings", "readings"),
    "b21_peak_flags": sql("SELECT ca_id, date, (isodow(date) <= 5 AND hour(date) IN (7, 8))::INT AS morning_peak, (isodow(date) <= 5 AND hour(date) = 18)::INT AS evening_peak, (isodow(date) > 5 OR hour(date) NOT IN (7, 8, 18))::INT AS off_peak FROM readings", "readings"),
    "b22_logs": sql("SELECT ca_id, date, round(ln(value + 1e-6), 6) AS ln, round(ln(1 + greatest(value - 50, 0)), 6) AS ln1p FROM readings", "readings"),
    "b24_bounded_logit": "SELECT l_orderkey, l_linenumber, round(ln(p / (1 - p)), 6) AS logit FROM (SELECT *, least(greatest(l_discount, 0.0001::DOUBLE), 1 - 0.0001::DOUBLE) AS p FROM lineitem)",
    "c2_join_models": sql("SELECT timestamp, round(a.aef, 6) AS aef, round(a.mef, 6) AS mef, round(b.aef, 6) AS aef_other, round(b.mef, 6) AS mef_other FROM factors a LEFT JOIN (SELECT * FROM factors WHERE aef > 200000) b USING (timestamp)", "factors"),
    "c3_join_location": sql("SELECT ca_id, date, round(value, 6) AS value, city, c_nationkey AS location_id FROM readings LEFT JOIN customer ON c_custkey = ca_id", "readings"),
    "c4_join_time_location": sql(", f AS (SELECT date, avg(value) AS factor FROM readings_30min GROUP BY date) SELECT ca_id, city, r.date, round(value, 6) AS value, c_nationkey AS location_id, round(CASE WHEN c_nationkey = 3 THEN factor END, 6) AS factor FROM readings_30min r LEFT JOIN customer ON c_custkey = ca_id LEFT JOIN f ON f.date = r.date", "readings_30min"),
    "c6_stack_grid_weather": sql("SELECT timestamp, location, round(temperature, 6) AS temperature, round(precipitation, 6) AS precipitation, round(thermal, 6) AS thermal FROM weather_hourly JOIN grid_5min USING (timestamp)", "weather_hourly", "grid_5min"),
    "e8_share_of_total": sql(", d AS (SELECT city, date::DATE AS day, sum(value) AS kwh FROM readings GROUP BY ALL) SELECT city, day, round(kwh, 6) AS kwh, round(kwh / sum(kwh) OVER (PARTITION BY day), 6) AS kwh_share FROM d", "readings"),
    "e9_carried_values": sql(
        """, x AS (SELECT timestamp, location, temperature, last_value(temperature IGNORE NULLS) OVER b AS prev_value, last_value(CASE WHEN temperature IS NOT NULL THEN timestamp END IGNORE NULLS) OVER b AS prev_time, first_value(temperature IGNORE NULLS) OVER a AS next_value, first_value(CASE WHEN temperature IS NOT NULL THEN timestamp END IGNORE NULLS) OVER a AS next_time FROM weather_hourly
WINDOW b AS (PARTITION BY location ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY location ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT timestamp, location, round(temperature, 6) AS temperature, round(prev_value, 6) AS prev_value, prev_time, round(next_value, 6) AS next_value, next_time, round(coalesce(temperature, prev_value + (next_value - prev_value) * epoch(timestamp - prev_time) / nullif(epoch(next_time - prev_time), 0)), 6) AS interpolated FROM x""",
        "weather_hourly",
    ),
    "e11_series_bounds": sql(", d AS (SELECT city, date::DATE AS day, sum(value) AS kwh FROM readings GROUP BY ALL) SELECT city, day, round(kwh, 6) AS kwh, round(first_value(kwh) OVER w, 6) AS first_kwh, round(last_value(kwh) OVER w, 6) AS last_kwh FROM d WINDOW w AS (PARTITION BY city ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "readings"),
    "f1_mixed_order": sql("SELECT city, date::DATE AS day, round(sum(value), 6) AS kwh FROM readings GROUP BY ALL ORDER BY day, sum(value) DESC, city", "readings"),
    "f2_top_times": sql("SELECT date, count(*) AS n FROM readings_30min GROUP BY date ORDER BY n DESC, date LIMIT 4", "readings_30min"),
    "g1_union": sql("SELECT timestamp, round(aef, 6) AS aef, NULL::DOUBLE AS mef FROM factors UNION ALL SELECT timestamp, trunc(mef), round(mef, 6) FROM factors", "factors"),
    "g2_totals": sql("SELECT city, round(sum(value), 6) AS value FROM readings GROUP BY city UNION ALL SELECT 'TOTAL', round(sum(value), 6) FROM readings", "readings"),
    "g6_membership": sql("SELECT ca_id, count(*) AS n FROM readings WHERE city IN ('click', 'view') GROUP BY ca_id", "readings"),
    "j14_me_for_split": sql("SELECT timestamp, round(mef, 6) AS ME, 'train' AS split FROM factors", "factors"),
    "j17_config_hash": """SELECT n_nationkey, n_name, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') AS config FROM nation""",
    "b36_classify_move": sql(
        _CAND + ", r AS (SELECT *, row_number() OVER (PARTITION BY ca_id, city, day, t ORDER BY mef_s, abs(s - t), s) AS r FROM cm), od AS (SELECT ca_id, city, day, sum(value) AS kwh FROM shift_input GROUP BY ALL), b AS (SELECT r.*, kwh, coalesce(sum(avail) OVER (PARTITION BY ca_id, city, day ORDER BY mef_t DESC, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN od USING (ca_id, city, day) WHERE r = 1 AND avail >= 0.01::DOUBLE * kwh), m AS (SELECT t, s, q * aef_s - q * aef_t AS d FROM (SELECT *, least(avail, greatest(0, 0.2::DOUBLE * kwh - before)) AS q FROM b) WHERE q > 0) SELECT CASE WHEN d < 0 THEN 'savings' WHEN d > 0 THEN 'increases' ELSE 'neutral' END AS category, CASE WHEN s > t THEN 'forward' WHEN s < t THEN 'backward' ELSE 'stay' END AS shift_direction, count(*) AS n FROM m GROUP BY ALL",
        "shift_input",
    ),
    "k11_preset_one": sql(greedy_sql(S.PRESETS[1]) + " SELECT city, count(*) AS moves, round(sum(q), 6) AS kwh FROM mv GROUP BY city", "shift_input", recursive=True),
}

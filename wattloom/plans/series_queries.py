"""Queries of joins, series quality, weather and grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions import columns as C
from wattloom.operators import grid as G
from wattloom.operators import joins as J
from wattloom.operators import quality as Q
from wattloom.operators import usage as U
from wattloom.operators import weather as W
from wattloom.plans.fixtures import Inputs, rounded, sql

KEY = ["location"]


def _q(f, digits: int = 6):
    return lambda spark, d: rounded(f(Inputs(spark, d)), digits)


def _orders(i: Inputs):
    return i.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ca_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("kwh"), F.col("o_orderpriority").alias("city"))


def _moves(i: Inputs):
    o = i.table("orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("city"), F.col("o_orderdate").alias("original_time"), C.plus_minutes("o_orderdate", 1440).alias("proposed_shift_time"))


def _labels(i: Inputs):
    o = i.table("orders").groupBy(F.col("o_orderpriority").alias("city"), F.col("o_orderdate").alias("timestamp")).agg(F.count("*").alias("n"))
    return o.select("city", "timestamp", F.when(F.col("n") > 1, "high").otherwise("low").alias("confidence"))


def _factor_table(i: Inputs):
    return i.table("orders").groupBy(F.year("o_orderdate").alias("year")).agg((F.avg("o_totalprice") / 1e6).alias("thermal_factor"), (F.max("o_totalprice") / 1e6).alias("gas_factor"))


def _confident(i: Inputs):
    return i.table("events").select(F.col("ts").alias("timestamp"), "value", F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "medium").otherwise("high").alias("confidence"))


def _weather(i: Inputs):
    return i.weather_hourly


def _audited(df):
    return df.select("timestamp", "location", "temperature", F.size(W.AUDIT).alias("n_events"), F.element_at(F.concat(W.AUDIT, F.array(F.struct(F.lit("").alias("column"), F.lit("").alias("method")))), 1)["method"].alias("method"))


_FILL = {"temperature": "filler"}
ON = ["timestamp", "location"]

QUERIES = {
    "b1_scope_filter": _q(lambda i: C.scope_filter(i.readings, "click", 2024)),
    "b2_date_range": _q(lambda i: C.date_range_filter(i.readings, "2024-01-10", "2024-01-12", closed=True)),
    "b3_time_columns": _q(lambda i: C.add_time_columns(i.readings.select("ca_id", "date"))),
    "b4_iso_week_label": _q(lambda i: i.table("orders").select("o_orderkey", C.iso_week_label("o_orderdate").alias("week"))),
    "b5_quarter_label": _q(lambda i: i.table("orders").select("o_orderkey", C.quarter_label("o_orderdate").alias("quarter"), C.days_in_month("o_orderdate").alias("days"))),
    "b7_day_and_slot": _q(lambda i: C.day_and_slot(i.readings.select("ca_id", "date"))),
    "b8_week_start": _q(lambda i: i.table("orders").select("o_orderkey", C.week_start("o_orderdate").alias("week_start"), C.weekday_name("o_orderdate").alias("weekday"))),
    "b9_localise": _q(lambda i: i.readings.select("ca_id", C.localise("date", "Asia/Kolkata").alias("utc"), C.convert("date", "UTC", "Asia/Kolkata").alias("local"))),
    "b11_datetime_features": _q(lambda i: C.datetime_features(i.readings.select("ca_id", "date"), "date")),
    "b12_fourier_time": _q(lambda i: C.fourier_time(i.readings.select("ca_id", "date"), "date")),
    "b15_generation_shares": _q(lambda i: C.generation_shares(i.grid_5min, ["thermal", "gas", "renewable"], "total")),
    "b16_net_load": _q(lambda i: i.grid_5min.select("timestamp", C.net_load("total", "renewable").alias("net"), C.is_sunny("renewable", 20.0).alias("sunny"))),
    "b18_cardinal": _q(lambda i: i.readings.select("ca_id", "date", *(C.degrees_to_cardinal("value", n).alias(f"c{n}") for n in (4, 8, 16)))),
    "b19_wind_from_uv": _q(lambda i: i.table("lineitem").select("l_orderkey", "l_linenumber", *(x.alias(n) for x, n in zip(C.wind_from_uv(F.col("l_quantity") - 25, F.col("l_discount") * 100 - 5.5), ("speed", "direction"), strict=True)))),
    "b20_convert_units": _q(lambda i: i.readings.select("ca_id", "date", C.mph_to_mps("value").alias("mps"), C.metres_to_mm("value").alias("mm"), C.kelvin_to_celsius("value").alias("celsius"), C.math_to_meteorological("value").alias("met"))),
    "b23_zero_inflated_log": _q(lambda i: i.readings.select("ca_id", "date", *(x.alias(n) for x, n in zip(C.zero_inflated_log("value", 30.0), ("occurs", "amount"), strict=True)), C.bounded_logit(F.col("value") / 500).alias("logit"))),
    "b30_grams": _q(lambda i: i.shift_input.select("ca_id", "day", "slot", C.grams_from_kwh("value", "mef").alias("grams"), C.me_grams_per_kwh(F.col("aef") / 1000).alias("g_per_kwh"), C.mw_to_kwh("value").alias("kwh"))),
    "b32_sanitize_city": _q(lambda i: i.table("orders").select(C.sanitize_city("o_orderpriority").alias("city")).distinct()),
    "b34_haversine": _q(lambda i: i.customer_points.select("ca_id", C.haversine_km("lat", "lon", F.lit(19.0), F.lit(73.0)).alias("km"))),
    "b35_radius": _q(lambda i: C.filter_by_radius(i.customer_points, "lat", "lon", (19.0, 73.0), 150.0)),
    "b39_year_emissions": _q(lambda i: J.year_specific_emissions(i.grid_5min.select("timestamp", "thermal", "gas", "tons_co2"), _factor_table(i), 1990, 2030, 5)),
    "c1_join_factors": _q(lambda i: J.join_factors(_orders(i).select("id", "timestamp"), i.factors)),
    "c5_fill_from_city": _q(lambda i: J.fill_from_city_average(i.weather_hourly.select("timestamp", F.col("location").alias("city"), "temperature"), J.city_mean_factors(i.weather_hourly.select("timestamp", F.lit("x").alias("_"), F.col("location").alias("city"), F.coalesce("temperature", F.lit(1.0)).alias("temperature")), ["temperature"]), ["temperature"], ["city", "timestamp"])),
    "c7_needed_rows": _q(lambda i: J.needed_rows(_orders(i), i.factors.where("mef > 400000"), "timestamp")),
    "c8_without_rows": _q(lambda i: J.without_rows(_orders(i), i.factors.where("mef > 400000"), "timestamp")),
    "c10_merge_parts": _q(lambda i: J.merge_parts([i.readings.groupBy("ca_id").agg(F.sum("value").alias("kwh")), i.table("customer").select(F.col("c_custkey").alias("ca_id"), "c_acctbal")], ["ca_id"])),
    "c11_nearest_location": _q(lambda i: J.nearest_location(i.customer_points, i.locations, "ca_id", "location_id")),
    "c12_validated_join": _q(lambda i: J.validated_left_join(_orders(i).select("id", "timestamp"), i.factors, ["timestamp"])),
    "c13_number_locations": _q(lambda i: J.number_locations(i.customer_points, ["lat", "lon"])[0]),
    "c14_moves_by_role": _q(lambda i: J.moves_by_role(_moves(i), _labels(i))),
    "c15_factor_years": _q(lambda i: J.emission_factor_years(_factor_table(i), 1990, 2030)),
    "c16_attach_floor": _q(lambda i: J.attach_household_floor(i.readings_30min, U.household_floor(i.readings_30min))),
    "l21_neighbour_distances": _q(lambda i: J.neighbour_distances(i.customer_points.withColumn("city", F.concat(F.lit("c"), F.col("ca_id") % 3)))),
    "d16_resample_30min": _q(lambda i: G.resample_30min(i.grid_5min, ["thermal", "gas", "renewable"], ["tons_co2"])),
    "d18_city_mean_factors": _q(lambda i: J.city_mean_factors(_orders(i), ["kwh"])),
    "d19_completeness": _q(lambda i: Q.completeness(i.weather_hourly, KEY, ["temperature", "precipitation"])),
    "d20_null_report": _q(lambda i: Q.null_report(i.weather_hourly, KEY, ["temperature", "precipitation"]).withColumn("gaps", F.size("gaps"))),
    "d21_isolated_nulls": _q(lambda i: Q.isolated_nulls(i.weather_hourly, "temperature", KEY)),
    "d22_regularity": _q(lambda i: Q.timestamp_regularity(i.weather_hourly.where("temperature is not null"), KEY)),
    "d24_generation_profile": _q(lambda i: G.generation_profile(i.grid_5min, ["thermal", "gas"])),
    "d27_nationalise": _q(lambda i: G.nationalise(_orders(i).withColumn("w", F.col("id") + 1), ["kwh"], "w", None, ["ca_id"], "id")),
    "d28_monthly_means": _q(lambda i: G.monthly_means(_orders(i), ["kwh"])),
    "d29_confidence_weighted": _q(lambda i: G.confidence_weighted(_confident(i), "value", "month")),
    "d30_confidence_counts": _q(lambda i: G.confidence_counts(_confident(i), "hour_year")),
    "d31_low_confidence": _q(lambda i: G.low_confidence_share(_confident(i), "value")),
    "e1_neighbours": _q(lambda i: Q.neighbours(i.weather_hourly.select("timestamp", "location", "precipitation"), "precipitation", KEY)),
    "e2_running_total": _q(lambda i: Q.running_total(i.weather_hourly.select("timestamp", "location", "precipitation"), "precipitation", KEY)),
    "e3_deaccumulate": _q(lambda i: W.deaccumulate(i.weather_hourly.select("timestamp", "location", "precipitation"), ["precipitation"], KEY).drop(W.AUDIT)),
    "e4_interval_columns": _q(lambda i: W.interval_columns(W.deaccumulate(i.weather_hourly.select("timestamp", "location", "precipitation"), ["precipitation"], KEY), ["precipitation"]).select("timestamp", "location", "precipitation_interval")),
    "e5_null_runs": _q(lambda i: Q.null_runs(i.weather_hourly, "temperature", KEY)),
    "g5_completeness_long": _q(lambda i: Q.completeness_long(i.weather_hourly, KEY, ["temperature", "precipitation"])),
    "h2_impute_isolated": _q(lambda i: _audited(W.impute_isolated(_weather(i), ["temperature"], KEY))),
    "h3_fill_hours": _q(lambda i: _audited(W.fill_hours_from(_weather(i), i.weather_filler, _FILL, ON))),
    "h4_fill_long_gaps": _q(lambda i: _audited(W.fill_long_gaps_from(_weather(i), i.weather_filler, _FILL, ON, KEY, 2))),
    "h5_fill_intervals": _q(lambda i: _audited(W.fill_intervals_from(_weather(i), i.weather_filler, _FILL, ON))),
    "h6_filler_columns": _q(lambda i: W.add_filler_columns(_weather(i), i.weather_filler, ["filler"], ON)),
    "h7_fill_guarded": _q(lambda i: W.fill_guarded(_weather(i).select("timestamp", "location", "temperature"), ["temperature"], KEY)),
    "i1_split_even": _q(lambda i: W.split_even(_weather(i), ["precipitation"], KEY)),
    "i2_split_rate_shaped": _q(lambda i: W.split_rate_shaped(_weather(i), ["precipitation"], KEY)),
    "i3_midpoint": _q(lambda i: W.midpoint(_weather(i), ["precipitation"], KEY)),
    "i4_wind_midpoint": _q(lambda i: W.wind_midpoint(_weather(i).select("timestamp", "location", F.lit(3.0).alias("speed"), (F.col("precipitation") % 150).alias("dir")), "speed", "dir", KEY)),
    "i5_static_fill": _q(lambda i: W.static_fill(_weather(i), ["temperature"], KEY, "nearest")),
    "i6_half_hourly": _q(lambda i: W.to_half_hourly(_weather(i), KEY, even=["precipitation"], means=["temperature"])),
    "l19_calibration_deltas": _q(lambda i: G.mef_aef_gap(i.factors)),
}

_PRI = "SELECT o_orderkey AS id, o_custkey AS ca_id, o_orderdate AS timestamp, o_totalprice AS kwh, o_orderpriority AS city FROM orders"
_W = "WINDOW w AS (PARTITION BY location ORDER BY timestamp)"
_RUN = """, n AS (SELECT *, temperature IS NULL AS gone FROM weather_hourly), c AS (SELECT *, CASE WHEN gone <> lag(gone) OVER w THEN 1 ELSE 0 END AS ch FROM n WINDOW w AS (PARTITION BY location ORDER BY timestamp)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY location ORDER BY timestamp)::BIGINT AS run_id FROM c)"""
_FACT = ", f AS (SELECT year(o_orderdate)::INT AS year, avg(o_totalprice) / 1e6 AS thermal_factor, max(o_totalprice) / 1e6 AS gas_factor FROM orders GROUP BY ALL), y AS (SELECT unnest(range(1990, 2031))::INT AS year), fy AS (SELECT y.year, f.thermal_factor, f.gas_factor FROM y ASOF LEFT JOIN f ON y.year <= f.year), fz AS (SELECT year, coalesce(thermal_factor, (SELECT arg_max(thermal_factor, year) FROM f)) AS thermal_factor, coalesce(gas_factor, (SELECT arg_max(gas_factor, year) FROM f)) AS gas_factor FROM fy)"
_HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
_CARD = {4: "['N','E','S','W']", 8: "['N','NE','E','SE','S','SW','W','NW']", 16: "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW']"}

SQL = {
    "b1_scope_filter": sql("SELECT ca_id, date, round(value, 6) AS value, city FROM readings WHERE city = 'click' AND year(date) = 2024", "readings"),
    "b2_date_range": sql("SELECT ca_id, date, round(value, 6) AS value, city FROM readings WHERE date BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'", "readings"),
    "b3_time_columns": sql("SELECT ca_id, date, date::DATE AS date_day, hour(date)::INT AS hour, year(date)::INT AS year, month(date)::INT AS month, isodow(date)::INT AS weekday, date_trunc('hour', date) AS hour_bin, isoyear(date)::INT AS iso_year, week(date)::INT AS iso_week FROM readings", "readings"),
    "b4_iso_week_label": "SELECT o_orderkey, isoyear(o_orderdate) || '-W' || lpad(week(o_orderdate)::VARCHAR, 2, '0') AS week FROM orders",
    "b5_quarter_label": "SELECT o_orderkey, 'Q' || quarter(o_orderdate) AS quarter, day(last_day(o_orderdate))::INT AS days FROM orders",
    "b7_day_and_slot": sql("SELECT ca_id, date, date::DATE AS day, (hour(date) * 2 + minute(date) // 30)::INT AS slot FROM readings", "readings"),
    "b8_week_start": "SELECT o_orderkey, date_trunc('week', o_orderdate)::DATE AS week_start, strftime(o_orderdate, '%a') AS weekday FROM orders",
    "b9_localise": sql("SELECT ca_id, date - INTERVAL 330 MINUTE AS utc, date + INTERVAL 330 MINUTE AS local FROM readings", "readings"),
    "b11_datetime_features": sql("SELECT ca_id, date, year(date)::INT AS year, month(date)::INT AS month, week(date)::INT AS week_of_year, day(date)::INT AS day, hour(date)::INT AS hour, (hour(date) * 2 + minute(date) // 30)::INT AS half_hour, isodow(date)::INT AS day_of_week, (isodow(date) >= 6)::INT AS is_weekend, minute(date)::INT AS minute, dayofyear(date)::INT AS day_of_year FROM readings", "readings"),
    "b12_fourier_time": sql(
        ", x AS (SELECT ca_id, date, 2 * pi() * (hour(date) + minute(date) / 60) / 24 AS h, 2 * pi() * (isodow(date) - 1) / 7 AS d, 2 * pi() * dayofyear(date) / 365 AS y, 2 * pi() * (month(date) - 1 + (day(date) - 1) / day(last_day(date))) / 12 AS m, (isodow(date) >= 6)::INT AS is_weekend FROM readings) SELECT ca_id, date, "
        + ", ".join(f"round({f}({v}), 6) + 0.0 AS {n}_{f}" for v, n in (("h", "hour"), ("d", "dow"), ("y", "doy"), ("m", "month")) for f in ("sin", "cos"))
        + ", is_weekend FROM x",
        "readings",
    ),
    "b15_generation_shares": sql("SELECT timestamp, round(thermal, 6) AS thermal, round(gas, 6) AS gas, round(renewable, 6) AS renewable, round(total, 6) AS total, round(tons_co2, 6) AS tons_co2, " + ", ".join(f"round({x} / nullif(total, 0) * 100, 6) AS {x}_share" for x in ("thermal", "gas", "renewable")) + " FROM grid_5min", "grid_5min"),
    "b16_net_load": sql("SELECT timestamp, round(total - renewable, 6) AS net, (renewable > 20)::INT AS sunny FROM grid_5min", "grid_5min"),
    "b18_cardinal": sql("SELECT ca_id, date, " + ", ".join(f"{_CARD[n]}[floor((value + {180 / n}::DOUBLE) % 360 / {360 / n}::DOUBLE)::INT + 1] AS c{n}" for n in (4, 8, 16)) + " FROM readings", "readings"),
    "b19_wind_from_uv": "SELECT l_orderkey, l_linenumber, round(sqrt(u * u + v * v), 6) AS speed, round((270 - degrees(atan2(v, u)) + 360) % 360, 6) AS direction FROM (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS u, l_discount * 100 - 5.5::DOUBLE AS v FROM lineitem)",
    "b20_convert_units": sql("SELECT ca_id, date, round(value * 0.44704::DOUBLE, 6) AS mps, round(value * 1000, 6) AS mm, round(value - 273.15::DOUBLE, 6) AS celsius, round((value + 180) % 360, 6) AS met FROM readings", "readings"),
    "b23_zero_inflated_log": sql("SELECT ca_id, date, (value > 30)::INT AS occurs, round(CASE WHEN value > 30 THEN ln(1 + value) ELSE 0 END, 6) AS amount, round(ln(p / (1 - p)), 6) AS logit FROM (SELECT *, least(greatest(value / 500, 0.0001::DOUBLE), 1 - 0.0001::DOUBLE) AS p FROM readings)", "readings"),
    "b30_grams": sql("SELECT ca_id, day, slot, round(value * mef, 6) AS grams, round(aef / 1000 / 0.5::DOUBLE * 1000, 6) AS g_per_kwh, round(value * 0.5::DOUBLE * 1000, 6) AS kwh FROM shift_input", "shift_input"),
    "b32_sanitize_city": "SELECT DISTINCT regexp_replace(lower(o_orderpriority), '[^a-z0-9_-]', '_', 'g') AS city FROM orders",
    "b34_haversine": sql("SELECT ca_id, round(" + _HAV.format(a="lat", b="19.0", c="lon", d="73.0") + ", 6) AS km FROM customer_points", "customer_points"),
    "b35_radius": sql("SELECT ca_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM customer_points WHERE " + _HAV.format(a="lat", b="19.0", c="lon", d="73.0") + " <= 150", "customer_points"),
    "b39_year_emissions": sql(
        _FACT + ", z AS (SELECT g.timestamp, thermal, gas, tons_co2, thermal_factor, gas_factor, thermal * thermal_factor / 12 AS tt, gas * gas_factor / 12 AS gt FROM grid_5min g LEFT JOIN fz ON least(greatest(year(g.timestamp), 1990), 2030) = fz.year) SELECT timestamp, round(thermal, 6) AS thermal, round(gas, 6) AS gas, round(tons_co2, 6) AS tons_co2, round(thermal_factor, 6) AS thermal_factor, round(gas_factor, 6) AS gas_factor, round(tt, 6) AS thermal_tons, round(gt, 6) AS gas_tons, round(tt + gt, 6) AS fuel_tons, round(tt + gt - tons_co2, 6) AS difference, round((tt + gt - tons_co2) / nullif(tons_co2, 0), 6) AS relative_difference FROM z",
        "grid_5min",
    ),
    "c1_join_factors": sql("SELECT id, timestamp, round(aef, 6) AS aef, round(mef, 6) AS mef FROM (" + _PRI + ") LEFT JOIN factors USING (timestamp)", "factors"),
    "c5_fill_from_city": sql("SELECT location AS city, timestamp, round(coalesce(temperature, 1.0), 6) AS temperature FROM weather_hourly", "weather_hourly"),
    "c7_needed_rows": sql("SELECT id, ca_id, timestamp, round(kwh, 6) AS kwh, city FROM (" + _PRI + ") SEMI JOIN (SELECT * FROM factors WHERE mef > 400000) USING (timestamp)", "factors"),
    "c8_without_rows": sql("SELECT id, ca_id, timestamp, round(kwh, 6) AS kwh, city FROM (" + _PRI + ") ANTI JOIN (SELECT * FROM factors WHERE mef > 400000) USING (timestamp)", "factors"),
    "c10_merge_parts": sql("SELECT ca_id, round(kwh, 6) AS kwh, round(c_acctbal, 6) AS c_acctbal FROM (SELECT ca_id, sum(value) AS kwh FROM readings GROUP BY ca_id) FULL JOIN (SELECT c_custkey AS ca_id, c_acctbal FROM customer) USING (ca_id)", "readings"),
    "c11_nearest_location": sql(", p AS (SELECT ca_id, c.lon, c.lat, location_id, " + _HAV.format(a="c.lat", b="l.lat", c="c.lon", d="l.lon") + " AS km FROM customer_points c CROSS JOIN locations l), b AS (SELECT *, row_number() OVER (PARTITION BY ca_id ORDER BY km, location_id) AS r FROM p) SELECT ca_id, round(lon, 6) AS lon, round(lat, 6) AS lat, location_id, round(km, 6) AS distance FROM b WHERE r = 1", "customer_points", "locations"),
    "c12_validated_join": sql("SELECT id, timestamp, round(aef, 6) AS aef, round(mef, 6) AS mef FROM (" + _PRI + ") LEFT JOIN factors USING (timestamp)", "factors"),
    "c13_number_locations": sql("SELECT ca_id, round(lon, 6) AS lon, round(lat, 6) AS lat, dense_rank() OVER (ORDER BY customer_points.lat, customer_points.lon) - 1 AS location_id FROM customer_points", "customer_points"),
    "c14_moves_by_role": """WITH m AS (SELECT o_orderkey AS id, o_orderpriority AS city, o_orderdate AS a, o_orderdate + INTERVAL 1 DAY AS b FROM orders),
l AS (SELECT o_orderpriority AS city, o_orderdate AS t, CASE WHEN count(*) > 1 THEN 'high' ELSE 'low' END AS c FROM orders GROUP BY ALL)
SELECT id, m.city, a AS original_time, b AS proposed_shift_time, s.c AS source_confidence, d.c AS destination_confidence, coalesce(s.c, d.c) AS confidence FROM m LEFT JOIN l s ON s.city = m.city AND s.t = a LEFT JOIN l d ON d.city = m.city AND d.t = b""",
    "c15_factor_years": "WITH _ AS (SELECT 1)" + _FACT + " SELECT year, round(thermal_factor, 6) AS thermal_factor, round(gas_factor, 6) AS gas_factor FROM fz",
    "c16_attach_floor": sql(
        ", o AS (SELECT ca_id, hour(date)::INT AS hod, isodow(date)::INT AS dow, list_sort(list(value)) AS v, avg(value) AS m FROM readings_30min GROUP BY ALL), f AS (SELECT ca_id, hod, dow, greatest(m, v[floor((len(v) - 1) * 0.1 + 0.5)::INT + 1], 0.001) AS f FROM o) SELECT r.ca_id, city, date, round(value, 6) AS value, round(coalesce(f, 0.0), 6) AS floor_kwh FROM readings_30min r LEFT JOIN f ON f.ca_id = r.ca_id AND hod = hour(date) AND dow = isodow(date)",
        "readings_30min",
    ),
    "l21_neighbour_distances": sql(
        ", p AS (SELECT ca_id AS a, 'c' || (ca_id % 3) AS city, lon, lat FROM customer_points), n AS (SELECT p.city, p.a, min(" + _HAV.format(a="p.lat", b="q.lat", c="p.lon", d="q.lon") + ") AS km FROM p JOIN p q ON p.city = q.city AND p.a <> q.a GROUP BY ALL) SELECT city, round(avg(km), 6) AS mean_km, round(quantile_cont(km, 0.5), 6) AS median_km, round(min(km), 6) AS min_km, round(max(km), 6) AS max_km, count(*) AS points FROM n GROUP BY city",
        "customer_points",
    ),
    "d16_resample_30min": sql(
        ", s AS (SELECT *, timestamp + INTERVAL 5 MINUTE AS e FROM grid_5min), c AS (SELECT *, CASE WHEN time_bucket(INTERVAL 30 MINUTE, e) = e THEN e ELSE time_bucket(INTERVAL 30 MINUTE, e) + INTERVAL 30 MINUTE END AS t FROM s) SELECT t AS timestamp, round(avg(thermal), 6) AS thermal, round(avg(gas), 6) AS gas, round(avg(renewable), 6) AS renewable, round(sum(tons_co2), 6) AS tons_co2 FROM c GROUP BY t",
        "grid_5min",
    ),
    "d18_city_mean_factors": "SELECT o_orderpriority AS city, o_orderdate AS timestamp, round(avg(o_totalprice), 6) AS kwh FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL",
    "d19_completeness": sql(", c AS (SELECT location, count(temperature) / count(*) AS t, count(precipitation) / count(*) AS p FROM weather_hourly GROUP BY location) SELECT location, round(t, 6) AS temperature, round(p, 6) AS precipitation, round((t + p) / 2, 6) AS mean, round(least(t, p), 6) AS min, round(greatest(t, p), 6) AS max FROM c", "weather_hourly"),
    "d20_null_report": sql(
        _RUN + ", e AS (SELECT *, lag(timestamp) OVER w IS NULL OR lead(timestamp) OVER w IS NULL AS edge FROM r WINDOW w AS (PARTITION BY location ORDER BY timestamp)), o AS (SELECT location, run_id, gone, count(*) AS n, bool_or(edge) AS edge FROM e GROUP BY ALL) SELECT location, 'temperature' AS column, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS nulls, count(*) FILTER (gone AND n = 1 AND NOT edge) AS isolated, (count(*) FILTER (gone AND n >= 2))::INT AS gaps FROM o GROUP BY location UNION ALL SELECT DISTINCT location, 'precipitation', 0, 0, 0 FROM o",
        "weather_hourly",
    ),
    "d21_isolated_nulls": sql(", l AS (SELECT location, temperature IS NULL AS gone, temperature IS NULL AND lag(temperature) OVER w IS NOT NULL AND lead(temperature) OVER w IS NOT NULL AS alone FROM weather_hourly " + _W + ") SELECT location, count(*) FILTER (gone) AS nulls, count(*) FILTER (alone) AS isolated FROM l GROUP BY location", "weather_hourly"),
    "d22_regularity": sql(", s AS (SELECT location, epoch(timestamp - lag(timestamp) OVER w)::BIGINT AS step FROM weather_hourly WHERE temperature IS NOT NULL " + _W + "), c AS (SELECT location, step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY ALL) SELECT location, count(*) AS n_steps, arg_max(step, n * 1000000 - step) AS modal_step_s, count(*) = 1 AS is_regular FROM c GROUP BY location", "weather_hourly"),
    "d24_generation_profile": sql("SELECT year(timestamp)::INT AS year, quarter(timestamp)::INT AS quarter, round(avg(thermal), 6) AS thermal, round(avg(gas), 6) AS gas, year(timestamp) || ' Q' || quarter(timestamp) AS label FROM grid_5min GROUP BY ALL", "grid_5min"),
    "d27_nationalise": "SELECT o_orderdate AS timestamp, round(sum(o_totalprice * (o_orderkey + 1)) / sum(o_orderkey + 1), 6) AS kwh, arg_min(o_custkey, o_orderkey) AS ca_id FROM orders GROUP BY ALL",
    "d28_monthly_means": "SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, round(avg(o_totalprice), 6) AS kwh FROM orders GROUP BY ALL",
    "d29_confidence_weighted": "SELECT year(ts)::INT AS year, month(ts)::INT AS month, round(sum(value), 6) AS total, " + ", ".join(f"round(coalesce(sum(value) FILTER ({c}), 0), 6) AS {n}, round(coalesce(sum(value) FILTER ({c}), 0) / sum(value), 6) AS {n}_share" for n, c in (("low", "value < 20"), ("medium", "value >= 20 AND value < 60"), ("high", "value >= 60"))) + " FROM events GROUP BY ALL",
    "d30_confidence_counts": "SELECT year(ts)::INT AS year, hour(ts)::INT AS hour, count(*) FILTER (value < 20) AS low, count(*) FILTER (value >= 20 AND value < 60) AS medium, count(*) FILTER (value >= 60) AS high FROM events GROUP BY ALL",
    "d31_low_confidence": "SELECT year(ts)::INT AS year, month(ts)::INT AS month, round(sum(value) FILTER (value < 20), 6) AS low, round(sum(value), 6) AS demand, round(sum(value) FILTER (value < 20) / sum(value), 6) AS low_share FROM events GROUP BY ALL",
    "e1_neighbours": sql("SELECT timestamp, location, round(precipitation, 6) AS precipitation, round(lag(precipitation) OVER w, 6) AS prev, round(lead(precipitation) OVER w, 6) AS next, date_diff('minute', lag(timestamp) OVER w, timestamp) AS minutes_since, date_diff('minute', timestamp, lead(timestamp) OVER w) AS minutes_until FROM weather_hourly " + _W, "weather_hourly"),
    "e2_running_total": sql("SELECT timestamp, location, round(precipitation, 6) AS precipitation, round(sum(precipitation) OVER (PARTITION BY location ORDER BY timestamp ROWS UNBOUNDED PRECEDING), 6) AS precipitation_running FROM weather_hourly", "weather_hourly"),
    "e3_deaccumulate": sql("SELECT timestamp, location, round(precipitation, 6) AS precipitation, round(CASE WHEN hour(timestamp) < 1 THEN NULL WHEN hour(timestamp) = 1 THEN greatest(precipitation, 0) WHEN lag(precipitation) OVER w IS NULL OR precipitation IS NULL THEN NULL ELSE greatest(precipitation - lag(precipitation) OVER w, 0) END, 6) AS precipitation_increment FROM weather_hourly WINDOW w AS (PARTITION BY location, timestamp::DATE ORDER BY timestamp)", "weather_hourly"),
    "e4_interval_columns": sql("SELECT timestamp, location, round(CASE WHEN hour(timestamp) <= 1 THEN precipitation ELSE greatest(precipitation - lag(precipitation) OVER w, 0) END, 6) AS precipitation_interval FROM weather_hourly WINDOW w AS (PARTITION BY location, timestamp::DATE ORDER BY timestamp)", "weather_hourly"),
    "e5_null_runs": sql(_RUN + " SELECT location, run_id, min(timestamp) AS gap_start, max(timestamp) AS gap_end, count(*) AS n FROM r WHERE gone GROUP BY location, run_id", "weather_hourly"),
    "g5_completeness_long": sql("SELECT location, 'temperature' AS column, round(count(temperature) / count(*), 6) AS ratio FROM weather_hourly GROUP BY location UNION ALL SELECT location, 'precipitation', round(count(precipitation) / count(*), 6) FROM weather_hourly GROUP BY location", "weather_hourly"),
    "h2_impute_isolated": sql(", x AS (SELECT *, CASE WHEN temperature IS NULL THEN (lag(temperature) OVER w + lead(temperature) OVER w) / 2 END AS m FROM weather_hourly " + _W + ") SELECT timestamp, location, round(coalesce(temperature, m), 6) AS temperature, (m IS NOT NULL)::INT AS n_events, CASE WHEN m IS NULL THEN '' ELSE 'avg_of_neighbors' END AS method FROM x", "weather_hourly"),
    "h3_fill_hours": sql(", x AS (SELECT *, temperature IS NULL AND hour(timestamp) = 0 AND filler IS NOT NULL AS m FROM weather_hourly JOIN weather_filler USING (timestamp, location)) SELECT timestamp, location, round(CASE WHEN m THEN filler ELSE temperature END, 6) AS temperature, m::INT AS n_events, CASE WHEN m THEN 'filled_from_filler_at_hour' ELSE '' END AS method FROM x", "weather_hourly", "weather_filler"),
    "h4_fill_long_gaps": sql(_RUN + ", l AS (SELECT *, count(*) OVER (PARTITION BY location, run_id) AS len FROM r), x AS (SELECT l.*, filler, gone AND len >= 2 AS m FROM l JOIN weather_filler USING (timestamp, location)) SELECT timestamp, location, round(CASE WHEN m THEN filler ELSE temperature END, 6) AS temperature, m::INT AS n_events, CASE WHEN m THEN 'filled_long_gap' ELSE '' END AS method FROM x", "weather_hourly", "weather_filler"),
    "h5_fill_intervals": sql("SELECT timestamp, location, round(coalesce(temperature, filler), 6) AS temperature, (temperature IS NULL)::INT AS n_events, CASE WHEN temperature IS NULL THEN 'filled_from_filler' ELSE '' END AS method FROM weather_hourly JOIN weather_filler USING (timestamp, location)", "weather_hourly", "weather_filler"),
    "h6_filler_columns": sql("SELECT timestamp, location, round(temperature, 6) AS temperature, round(precipitation, 6) AS precipitation, round(filler, 6) AS filler FROM weather_hourly LEFT JOIN weather_filler USING (timestamp, location)", "weather_hourly", "weather_filler"),
    "h7_fill_guarded": sql(
        """, x AS (SELECT timestamp, location, temperature, last_value(temperature IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN temperature IS NOT NULL THEN timestamp END IGNORE NULLS) OVER b AS t0, first_value(temperature IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN temperature IS NOT NULL THEN timestamp END IGNORE NULLS) OVER a AS t1 FROM weather_hourly
WINDOW b AS (PARTITION BY location ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY location ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
y AS (SELECT *, epoch(timestamp - t0) AS s, epoch(t1 - timestamp) AS u FROM x)
SELECT timestamp, location, round(coalesce(temperature, v0 + (v1 - v0) * s / nullif(s + u, 0), CASE WHEN v1 IS NULL AND s <= 1800 THEN v0 WHEN v0 IS NULL AND u <= 1800 THEN v1 END), 6) AS temperature FROM y""",
        "weather_hourly",
    ),
    "i1_split_even": sql(", x AS (SELECT *, lag(timestamp) OVER w AS p FROM weather_hourly " + _W + "), k AS (SELECT * FROM x WHERE timestamp - p = INTERVAL 1 HOUR) SELECT location, timestamp - INTERVAL 30 MINUTE AS timestamp, round(precipitation / 2, 6) AS precipitation FROM k UNION ALL SELECT location, timestamp, round(precipitation / 2, 6) FROM k", "weather_hourly"),
    "i2_split_rate_shaped": sql(
        ", x AS (SELECT location, timestamp, precipitation AS c, (coalesce(lag(precipitation) OVER w, precipitation) + precipitation) / 2 AS r0, (precipitation + coalesce(lead(precipitation) OVER w, precipitation)) / 2 AS r1 FROM weather_hourly " + _W + "), e AS (SELECT *, r0 / 2 + (r1 - r0) / 8 AS e1, r1 / 2 - (r1 - r0) / 8 AS e2 FROM x), s AS (SELECT *, c * coalesce(e1 / nullif(e1 + e2, 0), 0.5) AS a FROM e) SELECT location, timestamp - INTERVAL 30 MINUTE AS timestamp, round(a, 6) AS precipitation FROM s UNION ALL SELECT location, timestamp, round(c - a, 6) FROM s",
        "weather_hourly",
    ),
    "i3_midpoint": sql(", x AS (SELECT location, timestamp, lead(timestamp) OVER w AS n, (precipitation + lead(precipitation) OVER w) / 2 AS p FROM weather_hourly " + _W + ") SELECT location, timestamp + INTERVAL 30 MINUTE AS timestamp, round(p, 6) AS precipitation FROM x WHERE n - timestamp = INTERVAL 1 HOUR", "weather_hourly"),
    "i4_wind_midpoint": sql(", v AS (SELECT location, timestamp, 3.0::DOUBLE AS s, precipitation % 150 AS d FROM weather_hourly), x AS (SELECT location, timestamp, lead(timestamp) OVER w AS n, (s + lead(s) OVER w) / 2 AS s, (s * cos(radians(d)) + lead(s * cos(radians(d))) OVER w) / 2 AS x, (s * sin(radians(d)) + lead(s * sin(radians(d))) OVER w) / 2 AS y FROM v " + _W + ") SELECT location, timestamp + INTERVAL 30 MINUTE AS timestamp, round(s, 6) AS speed, round((degrees(atan2(y, x)) + 360) % 360, 6) AS dir FROM x WHERE n - timestamp = INTERVAL 1 HOUR", "weather_hourly"),
    "i5_static_fill": sql(", x AS (SELECT location, timestamp, lead(timestamp) OVER w AS n, coalesce(temperature, lead(temperature) OVER w) AS t FROM weather_hourly " + _W + ") SELECT location, timestamp + INTERVAL 30 MINUTE AS timestamp, round(t, 6) AS temperature FROM x WHERE n - timestamp = INTERVAL 1 HOUR", "weather_hourly"),
    "i6_half_hourly": sql(
        ", m AS (SELECT location, timestamp, lead(timestamp) OVER w AS n, lag(timestamp) OVER w AS p, temperature AS t, (temperature + lead(temperature) OVER w) / 2 AS mt, precipitation AS r FROM weather_hourly " + _W + "), a AS (SELECT location, timestamp, t FROM m UNION ALL SELECT location, timestamp + INTERVAL 30 MINUTE, mt FROM m WHERE n - timestamp = INTERVAL 1 HOUR), b AS (SELECT location, timestamp, r / 2 AS r FROM m WHERE timestamp - p = INTERVAL 1 HOUR UNION ALL SELECT location, timestamp - INTERVAL 30 MINUTE, r / 2 FROM m WHERE timestamp - p = INTERVAL 1 HOUR) SELECT location, timestamp, round(t, 6) AS temperature, round(r, 6) AS precipitation FROM a FULL JOIN b USING (location, timestamp)",
        "weather_hourly",
    ),
    "l19_calibration_deltas": sql("SELECT timestamp, round(aef, 6) AS aef, round(mef, 6) AS mef, round(mef - aef, 6) AS gap, round((mef - aef) / nullif(aef, 0), 6) AS gap_ratio FROM factors", "factors"),
}

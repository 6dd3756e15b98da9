"""Usage queries."""

from __future__ import annotations

from wattloom.operators import usage as U
from wattloom.plans.fixtures import Inputs, rounded, sql

_WEEKS = """, d AS (SELECT {k} date::DATE AS day, sum(value) AS t FROM readings GROUP BY ALL),
w AS (SELECT {k} isoyear(day)::INT AS year, week(day)::INT AS period, sum(t) AS observed, count(*) AS days_present, 7::BIGINT AS days FROM d GROUP BY ALL)"""
_MONTHS = """, d AS (SELECT {k} date::DATE AS day, sum(value) AS t FROM readings GROUP BY ALL),
w AS (SELECT {k} year(day)::INT AS year, month(day)::INT AS period, sum(t) AS observed, count(*) AS days_present, day(last_day(min(day)))::BIGINT AS days FROM d GROUP BY {k} year(day), month(day))"""
_OUT = " SELECT {k} year, period, round(observed, 6) AS observed, days_present, days, round(observed / days_present * days, 6) AS total, round(days_present / days, 6) AS coverage FROM w"


def _q(f, digits: int = 6):
    return lambda spark, d: rounded(f(Inputs(spark, d)), digits)


QUERIES = {
    "d1_daily_totals": _q(lambda i: U.daily_totals(i.readings)),
    "d2_hourly_totals_stats": _q(lambda i: U.hourly_totals_stats(i.readings)),
    "d3_extrapolate_week": _q(lambda i: U.extrapolate_period(i.readings, "week")),
    "d3_extrapolate_month": _q(lambda i: U.extrapolate_period(i.readings, "month")),
    "d3_extrapolate_year": _q(lambda i: U.extrapolate_period(i.readings, "year")),
    "d4_period_stats_week": _q(lambda i: U.period_stats(i.readings, "week")),
    "d5_customer_week_usage": _q(lambda i: U.customer_period_usage(i.readings, "week")),
    "d6_customer_week_summary": _q(lambda i: U.customer_period_summary(i.readings, "week")),
    "d7_scope_metrics": _q(lambda i: U.scope_metrics(i.readings)),
    "d8_zero_share": _q(lambda i: U.zero_share(i.readings)),
    "d9_weekend_profile": _q(lambda i: U.weekend_profile(i.readings)),
    "d10_top_share": _q(lambda i: U.top_share(i.readings, 0.1)),
    "d11_peak_hours": _q(lambda i: U.peak_hour_distribution(i.readings)),
    "d12_city_stats": _q(lambda i: U.file_stats(i.readings, "city")),
    "d13_monthly_city_totals": _q(lambda i: U.monthly_city_totals(i.readings, 2024)),
    "d14_coverage_halfhours": _q(lambda i: U.coverage_halfhours(i.readings)),
    "d15_household_floor": _q(lambda i: U.household_floor(i.readings_30min, 0.25, 0.8)),
    "d17_hourly_aggregate": _q(lambda i: U.hourly_aggregate(i.readings)),
    "d25_usage_emissions": _q(lambda i: U.usage_emissions(i.shift_input.withColumnRenamed("day", "date"), "mef", "week"), 7),
    "d26_series_summary": _q(lambda i: U.series_summary(i.readings, "value", 0)),
    "d43_readings_share": _q(lambda i: U.readings_share(i.readings, "city")),
    "d44_customer_lifetimes": _q(lambda i: U.customer_lifetimes(i.readings)),
    "d45_new_customers": _q(lambda i: U.new_customers_per_week(i.readings)),
    "d46_weekday_hour_profile": _q(lambda i: U.weekday_hour_profile(i.readings)),
    "d47_readings_summary": _q(lambda i: U.readings_summary(i.readings)),
    "d50_hour_profile": _q(lambda i: U.hour_profile(i.readings, ["value"], "weekday_hour")),
    "d51_rebin": _q(lambda i: U.rebin(i.readings, ["value"], 120, "median")),
    "d52_box_stats": _q(lambda i: U.box_stats(i.readings, "value")),
    "e6_rank_customers": _q(lambda i: U.rank_customers(i.readings)),
    "e7_top_hours": _q(lambda i: U.top_hours(i.readings, 6)),
    "f3_customer_order": _q(lambda i: U.customer_order(i.readings)),
    "g4_weekday_pivot": _q(lambda i: U.weekday_hour_pivot(i.readings)),
}

SQL = {
    "d1_daily_totals": sql("SELECT date::DATE AS day, round(sum(value), 6) AS total, count(*) AS n, count(*) FILTER (value > 0) AS n_nonzero FROM readings GROUP BY ALL", "readings"),
    "d2_hourly_totals_stats": sql(
        ", h AS (SELECT date_trunc('hour', date) AS hour, sum(value) AS t FROM readings GROUP BY ALL) SELECT round(avg(t), 6) AS mean_total, round(quantile_cont(t, 0.5), 6) AS median_total, count(*) AS n_hours FROM h",
        "readings",
    ),
    "d3_extrapolate_week": sql((_WEEKS + _OUT).format(k=""), "readings"),
    "d3_extrapolate_month": sql((_MONTHS + _OUT).format(k=""), "readings"),
    "d3_extrapolate_year": sql(
        _MONTHS.format(k="") + " SELECT year, round(sum(observed), 6) AS observed, sum(days_present)::BIGINT AS days_present, sum(days)::BIGINT AS days, round(sum(observed / days_present * days), 6) AS total, round(sum(days_present) / sum(days), 6) AS coverage FROM w GROUP BY year",
        "readings",
    ),
    "d4_period_stats_week": sql(
        _WEEKS.format(k="") + ", x AS (SELECT observed / days_present * days AS t, days_present / days AS c FROM w) SELECT round(avg(t), 6) AS mean_total, round(quantile_cont(t, 0.5), 6) AS median_total, round(avg(c), 6) AS mean_coverage, count(*) AS n_periods, round(avg(t) * 52, 6) AS annualised FROM x",
        "readings",
    ),
    "d5_customer_week_usage": sql((_WEEKS + _OUT).format(k="ca_id,"), "readings"),
    "d6_customer_week_summary": sql(
        _WEEKS.format(k="ca_id,") + ", m AS (SELECT year, period, avg(observed / days_present * days) AS m FROM w GROUP BY ALL) SELECT round(avg(m), 6) AS mean_usage, round(quantile_cont(m, 0.5), 6) AS median_usage, count(*) AS n_periods FROM m",
        "readings",
    ),
    "d7_scope_metrics": sql(
        """, d AS (SELECT city, date::DATE AS day, sum(value) AS t FROM readings GROUP BY ALL),
b AS (FROM d UNION ALL SELECT 'ALL', day, sum(t) FROM d GROUP BY day),
p AS (SELECT city, 'week' AS freq, isoyear(day) AS y, week(day) AS p, sum(t) / count(*) * 7 AS total, count(*) / 7 AS coverage FROM b GROUP BY ALL
 UNION ALL SELECT city, 'month', year(day), month(day), sum(t) / count(*) * day(last_day(min(day))), count(*) / day(last_day(min(day))) FROM b GROUP BY city, year(day), month(day)),
s AS (SELECT city, freq, count(*) AS n_periods, avg(total) AS a, quantile_cont(total, 0.5) AS b, avg(coverage) AS c FROM p GROUP BY ALL)
SELECT city, freq, 'total' AS metric, 'mean' AS stat, round(a, 6) AS value, n_periods FROM s UNION ALL SELECT city, freq, 'total', 'median', round(b, 6), n_periods FROM s UNION ALL SELECT city, freq, 'coverage', 'mean', round(c, 6), n_periods FROM s""",
        "readings",
    ),
    "d8_zero_share": sql("SELECT round(avg((value = 0)::INT), 6) AS zero_share FROM readings", "readings"),
    "d9_weekend_profile": sql(
        ", o AS (SELECT isodow(date) >= 6 AS weekend, hour(date)::INT AS hour, ca_id, avg(value) AS m FROM readings GROUP BY ALL) SELECT weekend, hour, round(avg(m), 6) AS mean_value, count(*) AS customers FROM o GROUP BY ALL",
        "readings",
    ),
    "d10_top_share": sql(
        ", t AS (SELECT ca_id, sum(value) AS t FROM readings GROUP BY ALL), r AS (SELECT t, row_number() OVER (ORDER BY t DESC) AS r, ceil(count(*) OVER () * 0.1)::BIGINT AS k FROM t) SELECT any_value(k) AS n_top, round(sum(t) FILTER (r <= k) / sum(t), 6) AS top_share FROM r",
        "readings",
    ),
    "d11_peak_hours": sql(
        ", h AS (SELECT ca_id, date::DATE AS day, hour(date)::INT AS hour, sum(value) AS t FROM readings GROUP BY ALL), p AS (SELECT hour, row_number() OVER (PARTITION BY ca_id, day ORDER BY t DESC, hour) AS r FROM h) SELECT hour AS peak_hour, count(*) AS customer_days FROM p WHERE r = 1 GROUP BY hour",
        "readings",
    ),
    "d12_city_stats": sql(
        ", o AS (SELECT city, ca_id, count(*) AS n, count(*) FILTER (value <> 0) AS nz, min(date) AS a, max(date) AS b, sum(value) AS v FROM readings GROUP BY ALL) SELECT city, count(*) AS customers, sum(n)::BIGINT AS n, sum(nz)::BIGINT AS n_nonzero, min(a) AS first, max(b) AS last, round(avg(n), 6) AS mean_readings, round(quantile_cont(n, 0.5), 6) AS median_readings, round(sum(v) / sum(n), 6) AS mean_value FROM o GROUP BY city",
        "readings",
    ),
    "d13_monthly_city_totals": sql((_MONTHS + _OUT).format(k="city,") + " WHERE year = 2024", "readings"),
    "d14_coverage_halfhours": sql(
        ", h AS (SELECT city, year(date)::INT AS year, date::DATE AS day, hour(date) * 2 + minute(date) // 30 AS slot, count(*) AS n FROM readings GROUP BY ALL), o AS (SELECT city, year, sum(n)::BIGINT AS readings, count(*) AS halfhours, (dayofyear(make_date(year, 12, 31)) * 48)::BIGINT AS expected FROM h GROUP BY city, year) SELECT *, round(readings / expected, 6) AS reading_ratio, round(halfhours / expected, 6) AS halfhour_ratio FROM o",
        "readings",
    ),
    "d15_household_floor": sql(
        ", o AS (SELECT ca_id, hour(date)::INT AS hod, isodow(date)::INT AS dow, list_sort(list(value)) AS v, avg(value) AS m FROM readings_30min GROUP BY ALL) SELECT ca_id, hod, dow, round(greatest(m, v[floor((len(v) - 1) * 0.25 + 0.5)::INT + 1] * 0.8, 0.001), 6) AS floor_kwh FROM o",
        "readings_30min",
    ),
    "d17_hourly_aggregate": sql("SELECT ca_id, city, date_trunc('hour', date) AS hour, round(sum(value), 6) AS total, round(avg(value), 6) AS mean_value FROM readings GROUP BY ALL", "readings"),
    "d25_usage_emissions": sql(
        ", o AS (SELECT ca_id, date_trunc('week', day)::DATE AS period, sum(value) AS kwh, avg(mef) AS factor FROM shift_input GROUP BY ALL) SELECT ca_id, period, round(kwh, 7) AS kwh, round(factor, 7) AS factor, round(kwh * factor, 7) AS grams, round(kwh * factor * 52, 7) AS annual_grams FROM o",
        "shift_input",
    ),
    "d26_series_summary": sql(
        ", m AS (SELECT round(value, 0) AS v, count(*) AS n FROM readings GROUP BY ALL) SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, count(value) AS n, (SELECT v FROM m ORDER BY n DESC, v LIMIT 1) AS mode FROM readings",
        "readings",
    ),
    "d43_readings_share": sql("SELECT city, count(*) AS n, round(count(*) / (SELECT count(*) FROM readings) * 100, 6) AS percent FROM readings GROUP BY city", "readings"),
    "d44_customer_lifetimes": sql("SELECT ca_id, min(date)::DATE AS first_day, max(date)::DATE AS last_day, (max(date)::DATE - min(date)::DATE + 1)::INT AS days FROM readings GROUP BY ca_id", "readings"),
    "d45_new_customers": sql(", f AS (SELECT min(date) AS f FROM readings GROUP BY ca_id) SELECT isoyear(f)::INT AS iso_year, week(f)::INT AS iso_week, count(*) AS new_customers FROM f GROUP BY ALL", "readings"),
    "d46_weekday_hour_profile": sql(
        ", h AS (SELECT date_trunc('hour', date) AS h, sum(value) AS t FROM readings GROUP BY ALL) SELECT isodow(h)::INT AS weekday, hour(h)::INT AS hour, round(avg(t), 6) AS mean_total, count(*) AS n_hours FROM h GROUP BY ALL",
        "readings",
    ),
    "d47_readings_summary": sql("SELECT count(DISTINCT ca_id) AS customers, count(DISTINCT city) AS cities, count(*) AS n, count(*) FILTER (value <> 0) AS n_nonzero, min(date) AS first, max(date) AS last FROM readings", "readings"),
    "d50_hour_profile": sql("SELECT isodow(date)::INT AS weekday, hour(date)::INT AS hour, round(avg(coalesce(value, 0)), 6) AS mean_value FROM readings GROUP BY ALL", "readings"),
    "d51_rebin": sql("SELECT time_bucket(INTERVAL 2 HOUR, date, TIMESTAMP '2000-01-01') AS bin, round(quantile_cont(value, 0.5), 6) AS value FROM readings GROUP BY ALL", "readings"),
    "d52_box_stats": sql(
        "SELECT month(date)::INT AS month, hour(date)::INT AS hour, round(min(value), 6) AS least, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS most, count(value) AS n FROM readings GROUP BY ALL",
        "readings",
    ),
    "e6_rank_customers": sql(
        ", t AS (SELECT city, date::DATE AS day, ca_id, sum(value) AS kwh FROM readings GROUP BY ALL) SELECT city, day, ca_id, round(kwh, 6) AS kwh, round((rank() OVER (PARTITION BY city, day ORDER BY kwh DESC) + (count(*) OVER (PARTITION BY city, day, kwh) - 1) / 2) / count(*) OVER (PARTITION BY city, day), 6) AS rank_share FROM t",
        "readings",
    ),
    "e7_top_hours": sql(
        ", m AS (SELECT isodow(date)::INT AS weekday, hour(date)::INT AS hour, avg(value) AS m FROM readings GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY weekday ORDER BY m DESC)::INT AS place FROM m) SELECT weekday, hour, round(m, 6) AS mean_value, place FROM r WHERE place <= 6",
        "readings",
    ),
    "f3_customer_order": sql(", t AS (SELECT city, date::DATE AS day, ca_id, sum(value) AS kwh FROM readings GROUP BY ALL) SELECT city, day, row_number() OVER (PARTITION BY city, day ORDER BY kwh DESC, ca_id)::INT AS place, ca_id, round(kwh, 6) AS kwh FROM t", "readings"),
    "g4_weekday_pivot": sql("SELECT hour(date)::INT AS hour, " + ", ".join(f'round(avg(value) FILTER (isodow(date) = {d}), 6) AS "{d}"' for d in range(1, 8)) + " FROM readings GROUP BY hour(date)", "readings"),
}

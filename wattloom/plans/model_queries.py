"""Queries of diagnostics, marginal factors, shifting and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions import columns as C
from wattloom.operators import diagnostics as D
from wattloom.operators import joins as J
from wattloom.operators import mef as M
from wattloom.operators import reports as R
from wattloom.operators import shift as S
from wattloom.plans.fixtures import Inputs, rounded, sql

P = S.Policy("one", moves_per_day=1, moves_per_week=3, window=4, regional_fraction=0.25)
SCENARIOS = [P, S.PRESETS[1], S.PRESETS[2]]
# amounts in the tables have two decimals and shares of them four: sums are rounded where all digits are kept
XY = ["q", "y", "x"]


def _q(f, digits: int = 4):
    return lambda spark, d: rounded(f(Inputs(spark, d)), digits)


def _ramps(i: Inputs):
    """Daily means of the model rows of each flag as a series; ME is the mean discount."""
    r = i.model_rows.groupBy(F.col("g").alias("city"), F.col("t").alias("timestamp")).agg(F.avg("q").alias("q"), (F.avg("y") / 1000).alias("y"), (F.avg("x") * 10).alias("ME"))
    return r


def _pairs(i: Inputs):
    return M.ramp_pairs(_ramps(i), "q", "y", "ME", max_minutes=2880, min_abs_dq=1.0)


def _moves(i: Inputs):
    return S.shift_load(i.shift_used, P, factors=i.shift_factors)


def _table(i: Inputs):
    return S.moves_table(_moves(i))


def _metrics(i: Inputs):
    return S.shift_metrics(i.shift_used, _moves(i), P)


def _splits(i: Inputs):
    return M.time_split(i.model_rows, [("train", "1990-01-01", "1997-01-01"), ("validation", "1997-01-01", "2000-01-01")], "t")


#: One configuration or two of each family.
FAMILIES = [
    {"bins": {"q": 3}, "controls": []}, {"bins": {"q": 3}, "controls": ["x"]}, {"bins": {"x": 4}, "controls": []},
    {"family": "poly", "degree": 2}, {"family": "poly", "degree": 3, "interactions": ["x"], "alpha": 10.0}, {"family": "huber", "degree": 2, "controls": ["x"]},
    {"family": "spline", "n": 8, "penalty": 10.0}, {"family": "spline", "n": 8, "penalty": 100.0, "controls": ["x"]}, {"family": "spline", "n": 8, "penalty": 10.0, "smooths": ["x"]},
]


def _scored(i: Inputs):
    return i.model_rows.withColumn("p", 1500 * F.col("q"))


def _ols_rows(i: Inputs):
    fits = M.groupwise_ols(i.model_rows, "y", ["q"], ["g", "s"])
    return fits.select("g", "s", F.col("coefficients")["const"].alias("a"), F.col("coefficients")["q"].alias("b"), "n", "r2", "rmse")


def _predicted(model):
    return lambda i: (lambda m: i.model_rows.groupBy("g").agg(F.avg(m.predict()).alias("mean_prediction"), F.avg(m.me()).alias("mean_me"), F.count("*").alias("n")))(model(i))


QUERIES = {
    "d32_energy_weights": _q(lambda i: M.energy_weights(i.model_rows, "q", ["g"])),
    "d33_macro_micro": _q(lambda i: M.macro_micro_means(M.point_metrics(_scored(i), "y", "p", ["g", "s"]), ["r2", "rmse"])),
    "d34_group_metrics": _q(lambda i: M.point_metrics(_scored(i), "y", "p", ["g", "s"])),
    "d35_energy_r2": _q(lambda i: M.point_metrics(_scored(i), "y", "p", weight="q").select("energy_r2")),
    "d36_summarise_metrics": _q(lambda i: M.summarise_metrics(M.point_metrics(_scored(i), "y", "p", ["g", "s"]).withColumnsRenamed({"g": "split", "s": "group_id"}), ["r2", "rmse"]).drop("metrics_by_group")),
    "d37_weighted_median_shift": _q(lambda i: S.weighted_median_shift(_moves(i), ["city"])),
    "d38_emissions_totals": _q(lambda i: S.emissions_totals(i.shift_input)),
    "d39_correlation": _q(lambda i: D.correlation_matrix(i.model_rows, XY)),
    "d40_vif": _q(lambda i: D.vif(i.model_rows, XY)),
    "d41_eigen": _q(lambda i: D.eigen_condition(i.model_rows.select(F.col("q") / 50, F.col("y") / 1e5, "x").toDF("q", "y", "x"), XY)),
    "d42_skew_kurtosis": _q(lambda i: D.skew_kurtosis(i.model_rows, XY)),
    "d48_outliers_zscore": _q(lambda i: D.outliers_zscore(i.readings, ["value"])),
    "d49_outliers_iqr": _q(lambda i: D.outliers_iqr(i.readings, ["value"])),
    "e12_ramp_pairs": _q(_pairs, 9),
    "e13_spearman": _q(lambda i: M.ramp_scores(_pairs(i)).select("city", "spearman")),
    "e14_cross_correlation": _q(lambda i: D.cross_correlation(i.grid_5min.withColumn("thermal", F.col("thermal") + F.minute("timestamp")), "thermal", "gas", 3)),
    "b26_winsorize": _q(lambda i: C.winsorize(i.readings, C.winsorize_fit(i.readings, ["value"], 0.05, 0.95))),
    "b27_standardise": _q(lambda i: C.standardise(i.readings, C.standardise_fit(i.readings, ["value"], True))),
    "b13_onehot": _q(lambda i: C.onehot(i.readings, C.onehot_fit(i.readings, ["city"]))),
    "b25_polynomial": _q(lambda i: C.polynomial_interactions(i.model_rows, "q", 3, ["x"]).groupBy("g").agg(*(F.avg(x).alias(x) for x in ("q_1", "q_2", "q_3", "q_x_x")))),
    "j1_quantile_bins": _q(lambda i: (lambda e: M.quantile_bins(i.model_rows, e).groupBy("q_bin", "x_bin", "group_id").agg(F.count("*").alias("n")))(M.quantile_bins_fit(i.model_rows, {"q": 4, "x": 3}))),
    "j2_median_groups": _q(lambda i: M.median_groups(i.model_rows, M.median_groups_fit(i.model_rows, ["q", "y"])).groupBy("median_group").agg(F.count("*").alias("n"))),
    "j3_qcut_labels": _q(lambda i: M.median_label_groups(M.qcut_groups(i.model_rows, "y", M.qcut_fit(i.model_rows, "y", 5), "bin"), M.median_groups_fit(i.model_rows, ["q"])).groupBy("bin", "label").agg(F.count("*").alias("n"))),
    "j4_groupwise_ols": _q(_ols_rows),
    "j5_groupwise_me": _q(lambda i: M.groupwise_me(i.model_rows, M.groupwise_ols(i.model_rows.withColumn("q2", F.col("q") * F.col("q")), "y", ["q", "q2"], ["g"]), "q", ["g"], "q", "q2").groupBy("g").agg(F.avg("ME").alias("mean_me"))),
    "j6_poly_ols": _q(_predicted(lambda i: M.poly_ols(i.model_rows, "q", "y", 1))),
    "j7_poly_ridge": _q(_predicted(lambda i: M.poly_ridge(i.model_rows, "q", "y", 2, ["x"], alphas=(0.1, 10.0)))),
    "j8_poly_huber": _q(_predicted(lambda i: M.poly_huber(i.model_rows, "q", "y", 2))),
    "j9_spline": _q(_predicted(lambda i: M.spline_fit(i.model_rows, "q", "y", linear=["x"], n=8))),
    "j9_spline_smooths": _q(_predicted(lambda i: M.spline_fit(i.model_rows, "q", "y", ["x"], n=8, penalty=(1.0, 10.0, 100.0)))),
    "j10_finite_difference": _q(lambda i: M.finite_difference_metrics(_ramps(i), "q", "y", "ME", max_minutes=2880, min_abs_dq=1.0)),
    "j11_calibrate": _q(lambda i: M.calibrated(_ramps(i), M.calibrate_wls(_pairs(i))).select("city", "timestamp", "ME_cal")),
    "j12_national_median": _q(lambda i: M.national_median(_ramps(i), ["ME"]), 6),
    "j13_confidence": _q(lambda i: M.confidence_table(_pairs(i), [1, 2, 5, 10])),
    "j15_time_split": _q(lambda i: M.time_split(i.model_rows, [("train", "1990-01-01", "1998-01-01"), ("test", "1998-01-01", "2000-01-01")], "t").groupBy("split").agg(F.count("*").alias("n"))),
    "j16_search_models": _q(lambda i: M.search_models(i.model_rows, "y", "q", [{"q": 3}, {"x": 4}], [[], ["x"]]).drop("params_json")),
    "j16_search_families": _q(lambda i: M.search_families(_splits(i), "y", "q", FAMILIES, "split").drop("params_json")),
    "j20_me_summary": _q(lambda i: M.me_summary(i.model_rows.withColumnRenamed("x", "ME"), ["g"])),
    "j21_best_models": _q(lambda i: M.best_models(i.model_rows.groupBy(F.concat("g", "s").alias("config")).agg(F.stddev_samp("q").alias("std"), F.avg("q").alias("mean")), "std", 3)),
    "k1_city_slot_baseline": _q(lambda i: S.city_slot_baseline(i.shift_input), 6),
    "k2_peak_targets": _q(lambda i: S.peak_targets(i.shift_input, {d: (7, 8, 18, 19) for d in range(1, 6)}, 0.25), 6),
    "k3_valid_slots": _q(lambda i: S.valid_slots(i.shift_input.withColumn("mef", F.when(F.col("slot") % 9 != 0, F.col("mef")))).groupBy("city", "valid").agg(F.count("*").alias("n")), 6),
    "k4_slot_arrays": _q(lambda i: S.slot_arrays(i.shift_input).select(*S.KEYS, F.size("value").alias("n"), F.aggregate("value", F.lit(0.0), lambda a, x: a + x).alias("kwh")), 6),
    "c9_candidate_moves": _q(lambda i: S.candidate_moves(i.shift_days, 4), 6),
    "k5_shift_load": _q(_moves, 6),
    "k6_upper_bound": _q(lambda i: S.shift_upper_bound(i.shift_input), 6),
    "k7_moves_table": _q(_table, 6),
    "k8_shift_metrics": _q(lambda i: _metrics(i).select(*S.KEYS, "baseline_kwh", "moved_kwh", "baseline_E_marg_g", "delta_E_marg_g", "post_E_marg_g", "weekly_moves_used", "weekly_moves_remaining"), 6),
    "k9_day_summary": _q(lambda i: S.day_summary(_metrics(i)), 6),
    "k10_optimised_readings": _q(lambda i: S.optimised_readings(i.shift_used, _moves(i)), 6),
    "k12_highest_sources": _q(lambda i: S.k_highest_sources(i.shift_input, 2).select(*S.KEYS, "slot", "place"), 6),
    "k13_share_capped": _q(lambda i: S.share_capped_greedy(i.shift_days, 4), 6),
    "k14_scenarios": _q(lambda i: S.scenario_metrics(i.shift_input, S.shift_scenarios(i.shift_used, SCENARIOS, factors=i.shift_factors)), 6),
    "l1_per_move_savings": _q(lambda i: R.per_move_savings(_table(i)), 6),
    "l2_household_week_savings": _q(lambda i: R.household_week_savings(_table(i)), 6),
    "l3_moves_by_category": _q(lambda i: R.moves_by_category(_table(i)), 6),
    "l3_giveback": _q(lambda i: R.giveback(_table(i)), 6),
    "l4_overall_reduction": _q(lambda i: R.overall_reduction(_metrics(i)), 4),
    "l5_weekly_coverage": _q(lambda i: R.weekly_move_coverage(_metrics(i)), 6),
    "l6_customers_with_shift": _q(lambda i: R.customers_with_shift(_metrics(i)), 6),
    "l7_origin_destination": _q(lambda i: R.origin_destination(_table(i)), 6),
    "l8_confidence_share": _q(lambda i: (lambda t: R.moves_confidence_share(J.moves_by_role(t, t.select("city", F.col("original_time").alias("timestamp")).distinct().withColumn("confidence", F.when(F.hour("timestamp") < 12, "low").otherwise("high")))))(_table(i)), 6),
    "l9_shift_size_distance": _q(lambda i: R.shift_size_distance(_table(i)), 6),
    "l10_emissions_savings": _q(lambda i: R.emissions_savings(_metrics(i)), 9),
    "l11_time_histogram": _q(lambda i: R.time_histogram(_table(i), "weekday_hour"), 6),
    "l12_customer_week_stats": _q(lambda i: R.customer_week_stats(_metrics(i)), 6),
    "l13_hour_pairs": _q(lambda i: R.hour_pair_stats(_table(i)), 6),
    "l14_weekday_hour_flow": _q(lambda i: R.weekday_hour_flow(_table(i)), 6),
    "l15_pre_post_profile": _q(lambda i: R.pre_post_profile(S.optimised_readings(i.shift_used, _moves(i), with_value=True)), 6),
    "l16_direction_by_hour": _q(lambda i: R.direction_by_hour(_table(i)), 6),
    "l17_quota_and_boundary": _q(lambda i: R.quota_and_boundary(_table(i), P.moves_per_day, P.window), 6),
    "l18_savings_disagreement": _q(lambda i: R.savings_disagreement(_metrics(i)), 6),
    "l20_usage_hourly": _q(lambda i: R.usage_hourly(i.readings), 6),
    "l22_weekly_summary": _q(lambda i: R.weekly_summary(_metrics(i)), 4),
}

_SC = ", sc AS (SELECT *, 1500 * q AS p FROM model_rows)"
_PM = "count(*) AS n, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, avg(abs(y - p) / abs(y)) AS mape"
_RP = """, ra AS (SELECT g AS city, t AS timestamp, avg(q) AS q, avg(y) / 1000 AS y, avg(x) * 10 AS ME FROM model_rows GROUP BY ALL),
rd AS (SELECT city, timestamp, epoch(timestamp - lag(timestamp) OVER w) / 60 AS minutes, q - lag(q) OVER w AS dq, y - lag(y) OVER w AS dy, (ME + lag(ME) OVER w) / 2 AS m FROM ra WINDOW w AS (PARTITION BY city ORDER BY timestamp)),
rp AS (SELECT *, dy / dq AS s FROM rd WHERE minutes > 0 AND minutes <= 2880 AND abs(dq) >= 1)"""
_CAND = """, cm AS (SELECT t.ca_id, t.city, t.day, t.slot AS t, s.slot AS s, t.value AS avail, t.mef AS mef_t, s.mef AS mef_s, t.aef AS aef_t, s.aef AS aef_s, (t.mef - s.mef) * t.value AS gain
FROM (SELECT *, unnest(range(greatest(slot - 4, 0), least(slot + 4, 47) + 1))::INT AS at FROM shift_input WHERE value > 0) t JOIN shift_input s ON s.ca_id = t.ca_id AND s.city = t.city AND s.day = t.day AND s.slot = t.at AND s.mef < t.mef)"""


def greedy_sql(p: S.Policy, x: str = "") -> str:
    """The greedy as a recursion over the households of a city and week: a step for each move they may take, with the
    room left in the region and the moves used so far. mv: the moves."""
    return f""", cm{x} AS (SELECT t.ca_id, t.city, t.day, t.slot AS t, s.slot AS s, t.value AS avail, t.mef AS mef_t, s.mef AS mef_s, t.aef AS aef_t, s.aef AS aef_s
FROM (SELECT *, unnest(range(greatest(slot - {p.window}, 0), least(slot + {p.window}, 47) + 1))::INT AS at FROM shift_input) t JOIN shift_input s ON s.ca_id = t.ca_id AND s.city = t.city AND s.day = t.day AND s.slot = t.at AND s.mef < t.mef),
cl{x} AS (SELECT ca_id, city, day, list({{'avail': avail, 'd': mef_t - mef_s, 't': t, 's': s}}) AS c FROM cm{x} GROUP BY ALL),
od{x} AS (SELECT ca_id, city, day, sum(value) AS kwh FROM shift_input GROUP BY ALL), ld{x} AS (SELECT city, day, sum(value) * {p.regional_fraction}::DOUBLE AS room FROM shift_input GROUP BY ALL),
st{x} AS MATERIALIZED (SELECT ca_id, city, day, k, date_trunc('week', day) AS week, room, c, row_number() OVER (PARTITION BY city, date_trunc('week', day) ORDER BY day, kwh DESC, ca_id, k) AS n
FROM od{x} JOIN ld{x} USING (city, day) JOIN cl{x} USING (ca_id, city, day), (SELECT unnest(range({p.moves_per_day})) AS k)),
gr{x} AS (SELECT city, week, 0::BIGINT AS n, NULL::DATE AS day, 0.0::DOUBLE AS room, MAP {{}}::MAP(BIGINT, INT) AS used, NULL::BIGINT AS ca_id, NULL::STRUCT(gain DOUBLE, t INT, s INT, q DOUBLE) AS m FROM st{x} GROUP BY ALL
UNION ALL SELECT city, week, n, day, room - coalesce(m.q, 0), CASE WHEN m.q IS NULL THEN used ELSE map_concat(used, MAP {{ca_id: coalesce(used[ca_id], 0) + 1}}) END, ca_id, m FROM (
SELECT *, CASE WHEN room > 1e-12 AND coalesce(used[ca_id], 0) < {p.moves_per_week} AND (k = 0 OR before.q IS NOT NULL) THEN list_max(list_filter(list_transform(c, lambda a: {{
 'gain': a.d * least(a.avail + CASE WHEN k > 0 AND a.t = -before.s THEN before.q ELSE 0 END, room), 't': -a.t, 's': -a.s, 'q': least(a.avail + CASE WHEN k > 0 AND a.t = -before.s THEN before.q ELSE 0 END, room)}}), lambda a: a.q > 1e-12 AND NOT (k > 0 AND a.t = before.t))) END AS m
FROM (SELECT gr{x}.city, gr{x}.week, st{x}.n, st{x}.day, st{x}.ca_id, st{x}.k, st{x}.c, gr{x}.used, gr{x}.m AS before, CASE WHEN gr{x}.day = st{x}.day THEN gr{x}.room ELSE st{x}.room END AS room FROM gr{x} JOIN st{x} ON st{x}.city = gr{x}.city AND st{x}.week = gr{x}.week AND st{x}.n = gr{x}.n + 1))),
mv{x} AS (SELECT ca_id, city, day, t, s, m.q AS q, mef_t, mef_s, aef_t, aef_s FROM gr{x} JOIN cm{x} USING (ca_id, city, day) WHERE t = -m.t AND s = -m.s)"""


_MV = greedy_sql(P)
_TB = _MV + """, tb AS (SELECT ca_id, city, day, day + to_minutes(t * 30) AS original_time, day + to_minutes(s * 30) AS proposed_shift_time, (s - t) * 30 AS delta_minutes, CASE WHEN s > t THEN 'forward' WHEN s < t THEN 'backward' ELSE 'stay' END AS shift_direction, q AS delta_kwh,
q * mef_t AS mb, q * mef_s AS ma, q * mef_s - q * mef_t AS md, q * aef_t AS ab, q * aef_s AS aa, q * aef_s - q * aef_t AS ad FROM mv)"""
_MT = _MV + """, em AS (SELECT ca_id, city, day, sum(value) AS baseline_kwh, sum(value * aef) AS ba, sum(value * mef) AS bm FROM shift_input GROUP BY ALL),
mt AS (SELECT em.*, coalesce(q * (aef_s - aef_t), 0) AS da, coalesce(q * (mef_s - mef_t), 0) AS dm, coalesce(q, 0) AS moved_kwh, sum((q IS NOT NULL)::INT) OVER (PARTITION BY ca_id, city, date_trunc('week', day) ORDER BY day)::BIGINT AS used FROM em LEFT JOIN mv USING (ca_id, city, day))"""


def _mt(text: str) -> str:
    return sql(_MT + " " + text, "shift_input", recursive=True)


def _tb(text: str) -> str:
    return sql(_TB + " " + text, "shift_input", recursive=True)


_RED = "round(sum(ba), 4) AS baseline_avg_g, round(sum(ba + da), 4) AS post_avg_g, round(sum(bm), 4) AS baseline_marg_g, round(sum(bm + dm), 4) AS post_marg_g, round(sum(moved_kwh), 4) AS moved_kwh, round(sum(baseline_kwh), 4) AS baseline_kwh, round((sum(ba) - sum(ba + da)) / sum(ba), 4) AS reduction_avg, round((sum(bm) - sum(bm + dm)) / sum(bm), 4) AS reduction_marg"

SQL = {
    "d32_energy_weights": sql("SELECT g, round(sum(q) * 0.5::DOUBLE, 4) AS energy FROM model_rows GROUP BY g", "model_rows"),
    "d33_macro_micro": sql(_SC + ", pm AS (SELECT g, s, " + _PM + " FROM sc GROUP BY ALL) SELECT round(avg(r2), 4) AS r2_macro, round(avg(rmse), 4) AS rmse_macro, round(sum(r2 * n) / sum(n), 4) AS r2_micro, round(sum(rmse * n) / sum(n), 4) AS rmse_micro FROM pm", "model_rows"),
    "d34_group_metrics": sql(_SC + ", pm AS (SELECT g, s, " + _PM + " FROM sc GROUP BY ALL) SELECT g, s, round(r2, 4) AS r2, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 4) AS mape, n FROM pm", "model_rows"),
    "d35_energy_r2": sql(_SC + " SELECT round(1 - sum(q * (y - p) * (y - p)) / (sum(q * y * y) - pow(sum(q * y), 2) / sum(q)), 4) AS energy_r2 FROM sc", "model_rows"),
    "d36_summarise_metrics": sql(_SC + ", pm AS (SELECT g, s, " + _PM + " FROM sc GROUP BY ALL) SELECT g AS split, round(avg(r2), 4) AS r2_macro, round(avg(rmse), 4) AS rmse_macro, round(sum(r2 * n) / sum(n), 4) AS r2_micro, round(sum(rmse * n) / sum(n), 4) AS rmse_micro FROM pm GROUP BY g", "model_rows"),
    "d37_weighted_median_shift": sql(_MV + ", d AS (SELECT city, abs(s - t) * 30 AS m, sum(q) AS q FROM mv GROUP BY ALL), c AS (SELECT city, m, sum(q) OVER (PARTITION BY city ORDER BY m) AS c, sum(q) OVER (PARTITION BY city) AS a FROM d) SELECT city, min(m) AS median_abs_shift_minutes FROM c WHERE c >= 0.5 * a - 1e-12 GROUP BY city", "shift_input", recursive=True),
    "d38_emissions_totals": sql("SELECT ca_id, city, day, round(sum(value), 4) AS baseline_kwh, round(sum(value * aef), 4) AS baseline_E_avg_g, round(sum(value * mef), 4) AS baseline_E_marg_g FROM shift_input GROUP BY ALL", "shift_input"),
    "d39_correlation": sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) + 0.0 AS r FROM model_rows" for a in XY for b in XY), "model_rows"),
    # the closed form of the eigenvalues of a symmetric 3 x 3 matrix
    "d41_eigen": sql(
        """, v AS (SELECT (q / 50)::DOUBLE AS a, (y / 1e5)::DOUBLE AS b, x::DOUBLE AS c FROM model_rows),
m AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(c * c) AS cc, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * c) AS bc FROM v),
t AS (SELECT *, (aa + bb + cc) / 3 AS t FROM m),
p AS (SELECT *, sqrt(((aa - t) * (aa - t) + (bb - t) * (bb - t) + (cc - t) * (cc - t) + 2 * (ab * ab + ac * ac + bc * bc)) / 6) AS p FROM t),
d AS (SELECT *, ((aa - t) * ((bb - t) * (cc - t) - bc * bc) - ab * (ab * (cc - t) - bc * ac) + ac * (ab * bc - (bb - t) * ac)) / (p * p * p) / 2 AS r FROM p),
f AS (SELECT *, acos(greatest(-1, least(1, r))) / 3 AS f FROM d),
e AS (SELECT t + 2 * p * cos(f) AS e0, t + 2 * p * cos(f + 2 * pi() / 3) AS e2, t FROM f)
SELECT n::INT AS nth, round([e0, 3 * t - e0 - e2, e2][n + 1], 4) AS eigenvalue, round(sqrt(e0 / e2), 4) AS condition FROM e, (SELECT unnest([0, 1, 2]) AS n)""",
        "model_rows",
    ),
    "d42_skew_kurtosis": sql(" UNION ALL ".join(f"SELECT '{a}' AS column, round(avg(pow(({a} - mu) / sd, 3)), 4) + 0.0 AS skewness, round(avg(pow(({a} - mu) / sd, 4)) - 3, 4) AS kurtosis FROM model_rows, (SELECT avg({a}) AS mu, stddev_pop({a}) AS sd FROM model_rows)" for a in XY), "model_rows"),
    "d48_outliers_zscore": sql("SELECT 'value' AS column, count(*) FILTER (abs(value - m) > 3 * s) AS outliers, round(count(*) FILTER (abs(value - m) > 3 * s) / count(value) * 100, 4) AS percent FROM readings, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM readings)", "readings"),
    "d49_outliers_iqr": sql(", b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM readings) SELECT 'value' AS column, count(*) FILTER (value < a - (c - a) * 1.5 OR value > c + (c - a) * 1.5) AS outliers, round(count(*) FILTER (value < a - (c - a) * 1.5 OR value > c + (c - a) * 1.5) / count(value) * 100, 4) AS percent FROM readings, b", "readings"),
    "e12_ramp_pairs": sql(_RP + " SELECT city, timestamp, round(minutes, 9) AS minutes, round(dq, 9) AS dq, round(dy, 9) AS dy, round(m, 9) AS m, round(s, 9) AS s FROM rp", "model_rows"),
    "e13_spearman": sql(_RP + ", rk AS (SELECT city, rank() OVER (PARTITION BY city ORDER BY s) + (count(*) OVER (PARTITION BY city, s) - 1) / 2 AS a, rank() OVER (PARTITION BY city ORDER BY m) + (count(*) OVER (PARTITION BY city, m) - 1) / 2 AS b FROM rp) SELECT city, round(corr(a, b), 4) AS spearman FROM rk GROUP BY city", "model_rows"),
    "e14_cross_correlation": sql(", h AS (SELECT date_trunc('hour', timestamp) AS h, avg(thermal + minute(timestamp)) AS x, avg(gas) AS y FROM grid_5min GROUP BY ALL), l AS (SELECT unnest(range(-3, 4))::INT AS lag) SELECT lag, round(corr(a.x, b.y), 4) AS r, count(*) AS n FROM l, h a JOIN h b ON b.h = a.h + to_hours(lag) GROUP BY lag", "grid_5min"),
    "b26_winsorize": sql("SELECT ca_id, date, round(least(greatest(value, a), b), 4) AS value, city FROM readings, (SELECT quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM readings)", "readings"),
    "b27_standardise": sql("SELECT ca_id, date, round((value - m) / (c - a), 4) + 0.0 AS value, city FROM readings, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS c FROM readings)", "readings"),
    "b13_onehot": sql("SELECT ca_id, date, round(value, 4) AS value, city, " + ", ".join(f"(city = '{x}')::INT AS city_{x}" for x in ("error", "purchase", "signup", "view")) + " FROM readings", "readings"),
    "b25_polynomial": sql("SELECT g, round(avg(q), 4) AS q_1, round(avg(q * q), 4) AS q_2, round(avg(q * q * q), 4) AS q_3, round(avg(q * x), 4) AS q_x_x FROM model_rows GROUP BY g", "model_rows"),
    "j1_quantile_bins": sql(
        ", l AS (SELECT list_sort(list(q)) AS q, list_sort(list(x)) AS x, count(*) - 1 AS n FROM model_rows), e AS (SELECT list_distinct([" + ", ".join(f"(q[floor({k}::DOUBLE / 4 * n + 1e-9)::BIGINT + 1] + q[ceil({k}::DOUBLE / 4 * n - 1e-9)::BIGINT + 1]) / 2" for k in (1, 2, 3)) + "]) AS eq, list_distinct([" + ", ".join(f"(x[floor({k}::DOUBLE / 3 * n + 1e-9)::BIGINT + 1] + x[ceil({k}::DOUBLE / 3 * n - 1e-9)::BIGINT + 1]) / 2" for k in (1, 2)) + "]) AS ex FROM l), b AS (SELECT (1 + len(list_filter(eq, lambda v: v < q)))::INT AS q_bin, (1 + len(list_filter(ex, lambda v: v < x)))::INT AS x_bin, len(ex) + 1 AS k FROM model_rows, e) SELECT q_bin, x_bin, ((q_bin - 1) * k + x_bin)::INT AS group_id, count(*) AS n FROM b GROUP BY ALL",
        "model_rows",
    ),
    "j5_groupwise_me": sql(", c AS (SELECT g, covar_pop(q, q) AS a, covar_pop(q, q * q) AS b, covar_pop(q * q, q * q) AS d, covar_pop(q, y) AS u, covar_pop(q * q, y) AS v, avg(q) AS m FROM model_rows GROUP BY g) SELECT g, round((u * d - v * b) / (a * d - b * b) + 2 * (v * a - u * b) / (a * d - b * b) * m, 4) AS mean_me FROM c", "model_rows"),
    "d40_vif": sql(", c AS (SELECT corr(q, y) AS a, corr(q, x) AS b, corr(y, x) AS c FROM model_rows), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c) SELECT 'q' AS column, round((1 - c * c) / det, 4) AS vif FROM d UNION ALL SELECT 'y', round((1 - b * b) / det, 4) FROM d UNION ALL SELECT 'x', round((1 - a * a) / det, 4) FROM d", "model_rows"),
    "j2_median_groups": sql("SELECT ((q > a)::INT * 2 + (y > b)::INT + 1)::INT AS median_group, count(*) AS n FROM model_rows, (SELECT quantile_cont(q, 0.5) AS a, quantile_cont(y, 0.5) AS b FROM model_rows) GROUP BY ALL", "model_rows"),
    "j3_qcut_labels": sql("SELECT ((y > e[1])::INT + (y > e[2])::INT + (y > e[3])::INT + (y > e[4])::INT)::INT AS bin, 'q: ' || CASE WHEN q > m THEN 'Above Median' ELSE 'Below Median' END AS label, count(*) AS n FROM model_rows, (SELECT quantile_cont(y, [0.2, 0.4, 0.6, 0.8]) AS e, quantile_cont(q, 0.5) AS m FROM model_rows) GROUP BY ALL", "model_rows"),
    "j4_groupwise_ols": sql("SELECT g, s, round(regr_intercept(y, q), 4) AS a, round(regr_slope(y, q), 4) AS b, count(*) AS n, round(regr_r2(y, q), 4) AS r2, round(sqrt((regr_syy(y, q) - regr_sxy(y, q) * regr_sxy(y, q) / regr_sxx(y, q)) / count(*)), 4) AS rmse FROM model_rows GROUP BY g, s", "model_rows"),
    "j6_poly_ols": sql("SELECT g, round(avg(a + b * q), 4) AS mean_prediction, round(any_value(b), 4) AS mean_me, count(*) AS n FROM model_rows, (SELECT regr_intercept(y, q) AS a, regr_slope(y, q) AS b FROM model_rows) GROUP BY g", "model_rows"),
    "j10_finite_difference": sql(
        _RP + ", al AS (SELECT city, s, m FROM rp UNION ALL SELECT 'ALL', s, m FROM rp), rk AS (SELECT *, rank() OVER (PARTITION BY city ORDER BY s) + (count(*) OVER (PARTITION BY city, s) - 1) / 2 AS a, rank() OVER (PARTITION BY city ORDER BY m) + (count(*) OVER (PARTITION BY city, m) - 1) / 2 AS b FROM al) SELECT city, round(corr(s, m), 4) AS pearson, round(corr(a, b), 4) AS spearman, round(sqrt(avg((s - m) * (s - m))), 4) AS rmse, round(avg(abs(s - m)), 4) AS mae, count(*) AS n_pairs FROM rk GROUP BY city",
        "model_rows",
    ),
    "j11_calibrate": sql(_RP + ", w AS (SELECT sum(abs(dq)) AS w, sum(abs(dq) * m) AS m, sum(abs(dq) * s) AS s, sum(abs(dq) * m * m) AS mm, sum(abs(dq) * m * s) AS ms FROM rp), b AS (SELECT (w * ms - m * s) / (w * mm - m * m) AS b, w, m, s FROM w) SELECT city, timestamp, round((s - b * m) / w + b * ME, 4) AS ME_cal FROM ra, b", "model_rows"),
    "j12_national_median": sql(_RP + " SELECT timestamp, round(quantile_cont(ME, 0.5), 6) AS ME FROM ra GROUP BY timestamp", "model_rows"),
    "j13_confidence": sql(_RP + " " + " UNION ALL ".join(f"SELECT {t}.0::DOUBLE AS tau, round(corr(s, m) FILTER (abs(dq) >= {t}), 4) AS r FROM rp" for t in (1, 2, 5, 10)), "model_rows"),
    "j15_time_split": sql("SELECT CASE WHEN t < TIMESTAMP '1998-01-01' THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM model_rows WHERE t >= TIMESTAMP '1990-01-01' AND t < TIMESTAMP '2000-01-01' GROUP BY ALL", "model_rows"),
    "j20_me_summary": sql("SELECT g, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.75), 4) AS q3, round(max(x), 4) AS max FROM model_rows GROUP BY g", "model_rows"),
    "j21_best_models": sql("SELECT g || s AS config, round(stddev_samp(q), 4) AS std, round(avg(q), 4) AS mean FROM model_rows GROUP BY g, s ORDER BY stddev_samp(q), 1 LIMIT 3", "model_rows"),
    "k1_city_slot_baseline": sql("SELECT city, day, slot, round(sum(value), 6) AS baseline FROM shift_input GROUP BY ALL", "shift_input"),
    "k2_peak_targets": sql("SELECT city, day, slot, round(sum(value) * 0.25::DOUBLE, 6) AS room FROM shift_input WHERE isodow(day) <= 5 AND slot // 2 IN (7, 8, 18, 19) GROUP BY ALL", "shift_input"),
    "k3_valid_slots": sql("SELECT city, slot % 9 <> 0 AS valid, count(*) AS n FROM shift_input GROUP BY ALL", "shift_input"),
    "k4_slot_arrays": sql("SELECT ca_id, city, day, count(*)::INT AS n, round(sum(value), 6) AS kwh FROM shift_input GROUP BY ALL", "shift_input"),
    "c9_candidate_moves": sql(_CAND + " SELECT ca_id, city, day, t, s, round(avail, 6) AS avail, mef_t, aef_t, mef_s, aef_s, round(gain, 6) AS gain FROM cm", "shift_input"),
    "k5_shift_load": sql(_MV + " SELECT ca_id, city, day, t, s, round(q, 6) AS q, mef_t, mef_s, aef_t, aef_s FROM mv", "shift_input", recursive=True),
    "k6_upper_bound": sql("SELECT ca_id, city, day, round(sum(value), 6) AS kwh, round(sum(value * mef), 6) AS baseline_grams, min(mef) AS least_mef, arg_min(slot, mef * 100 + slot) AS slot, round(sum(value) * min(mef), 6) AS bound_grams, round(sum(value * mef) - sum(value) * min(mef), 6) AS saving_grams FROM shift_input GROUP BY ALL", "shift_input"),
    "k7_moves_table": _tb("SELECT ca_id, city, day, original_time, proposed_shift_time, delta_minutes, shift_direction, round(delta_kwh, 6) AS delta_kwh, round(mb, 6) AS marginal_emissions_before_shift_grams_co2, round(ma, 6) AS marginal_emissions_after_shift_grams_co2, round(md, 6) AS marginal_emissions_delta_grams_co2, round(ab, 6) AS average_emissions_before_shift_grams_co2, round(aa, 6) AS average_emissions_after_shift_grams_co2, round(ad, 6) + 0.0 AS average_emissions_delta_grams_co2 FROM tb"),
    "k8_shift_metrics": _mt("SELECT ca_id, city, day, round(baseline_kwh, 6) AS baseline_kwh, round(moved_kwh, 6) AS moved_kwh, round(bm, 6) AS baseline_E_marg_g, round(dm, 6) AS delta_E_marg_g, round(bm + dm, 6) AS post_E_marg_g, used AS weekly_moves_used, 3 - used AS weekly_moves_remaining FROM mt"),
    "k9_day_summary": _mt("SELECT city, day, count(*) AS n_customers_solved, round(sum(moved_kwh), 6) AS moved_kwh_day_sum, 'day_summary' AS row_type FROM mt GROUP BY ALL"),
    "k10_optimised_readings": sql(_MV + ", f AS (SELECT ca_id, city, day, t AS slot, -q AS q FROM mv UNION ALL SELECT ca_id, city, day, s, q FROM mv), g AS (SELECT ca_id, city, day, slot, sum(q) AS q FROM f GROUP BY ALL) SELECT ca_id, city, day, slot, round(value + coalesce(q, 0), 6) + 0.0 AS optimised_value FROM shift_input LEFT JOIN g USING (ca_id, city, day, slot)", "shift_input", recursive=True),
    "k12_highest_sources": sql(", r AS (SELECT ca_id, city, day, slot, row_number() OVER (PARTITION BY ca_id, city, day ORDER BY mef DESC, slot)::INT AS place FROM shift_input WHERE value > 0) SELECT * FROM r WHERE place <= 2", "shift_input"),
    "k13_share_capped": sql(
        _CAND + ", r AS (SELECT *, row_number() OVER (PARTITION BY ca_id, city, day, t ORDER BY mef_s, abs(s - t), s) AS r FROM cm), od AS (SELECT ca_id, city, day, sum(value) AS kwh FROM shift_input GROUP BY ALL), b AS (SELECT r.*, kwh, coalesce(sum(avail) OVER (PARTITION BY ca_id, city, day ORDER BY mef_t DESC, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN od USING (ca_id, city, day) WHERE r = 1 AND avail >= 0.01::DOUBLE * kwh) SELECT ca_id, city, day, t, s, round(least(avail, greatest(0, 0.2::DOUBLE * kwh - before)), 6) AS q, mef_t, mef_s, aef_t, aef_s FROM b WHERE least(avail, greatest(0, 0.2::DOUBLE * kwh - before)) > 0",
        "shift_input",
    ),
    "k14_scenarios": sql(
        "".join(greedy_sql(p, str(i)) for i, p in enumerate(SCENARIOS)) + ", al AS (" + " UNION ALL ".join(f"SELECT '{p.name}' AS policy, t, s, q FROM mv{i}" for i, p in enumerate(SCENARIOS))
        + ") SELECT policy, round(sum(q), 6) AS moved_kwh, round(coalesce(sum(q) FILTER (s > t), 0), 6) AS forward_kwh, round(coalesce(sum(q) FILTER (s < t), 0), 6) AS backward_kwh, round(sum(q) / (SELECT sum(value) FROM shift_input), 6) AS share_moved FROM al GROUP BY policy",
        "shift_input", recursive=True,
    ),
    "l1_per_move_savings": _tb("SELECT city, round(avg(-md), 6) AS mean, round(quantile_cont(-md, 0.5), 6) AS median, round(quantile_cont(-md, 0.75), 6) AS p75, count(*) AS n FROM tb GROUP BY city"),
    "l2_household_week_savings": _tb(", w AS (SELECT city, ca_id, isoyear(day), week(day), sum(-md) AS s FROM tb GROUP BY ALL) SELECT city, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.75), 6) AS p75, count(*) AS n FROM w GROUP BY city"),
    "l3_moves_by_category": _tb("SELECT CASE WHEN md < 0 THEN 'savings' WHEN md > 0 THEN 'increases' ELSE 'neutral' END AS category, count(*) AS moves, round(sum(delta_kwh), 6) AS kwh, round(sum(md), 6) AS grams FROM tb GROUP BY ALL"),
    "l3_giveback": _tb("SELECT round(sum(-md) FILTER (md < 0), 6) AS saved, 0.0::DOUBLE AS given_back, 0.0::DOUBLE AS giveback_ratio, 1.0::DOUBLE AS realisation_rate FROM tb"),
    "l4_overall_reduction": _mt("SELECT city, " + _RED + " FROM mt GROUP BY city UNION ALL SELECT 'TOTAL', " + _RED + " FROM mt"),
    "l5_weekly_coverage": _mt(", w AS (SELECT city, ca_id, isoyear(day), week(day), sum(moved_kwh) AS k FROM mt GROUP BY ALL) SELECT city, count(*) AS customer_weeks, count(*) FILTER (k > 0) AS with_moves, round(avg((k > 0)::INT), 6) AS coverage, round(avg(k), 6) AS mean_kwh FROM w GROUP BY city"),
    "l6_customers_with_shift": _mt(", o AS (SELECT city, ca_id, max((moved_kwh > 0)::INT) AS f FROM mt GROUP BY ALL) SELECT city, count(*) AS customers, sum(f)::BIGINT AS with_shift, round(avg(f), 6) AS share FROM o GROUP BY city"),
    "l7_origin_destination": _tb("SELECT hour(original_time)::INT AS origin, " + ", ".join(f'round(coalesce(sum(delta_kwh) FILTER (hour(proposed_shift_time) = {h}), 0), 6) AS "{h}"' for h in range(24)) + " FROM tb GROUP BY ALL"),
    "l8_confidence_share": _tb(
        ", l AS (SELECT DISTINCT city, original_time AS ts, CASE WHEN hour(original_time) < 12 THEN 'low' ELSE 'high' END AS c FROM tb), j AS (SELECT tb.*, coalesce(a.c, b.c, 'unknown') AS confidence FROM tb LEFT JOIN l a ON a.city = tb.city AND a.ts = original_time LEFT JOIN l b ON b.city = tb.city AND b.ts = proposed_shift_time) SELECT confidence, count(*) AS moves, round(sum(delta_kwh), 6) AS kwh, round(sum(md), 6) AS grams, round(count(*) / (SELECT count(*) FROM tb), 6) AS moves_share, round(sum(delta_kwh) / (SELECT sum(delta_kwh) FROM tb), 6) AS kwh_share FROM j GROUP BY confidence"
    ),
    "l9_shift_size_distance": _tb("SELECT city, round(avg(delta_kwh), 6) AS mean_kwh, round(quantile_cont(delta_kwh, 0.5), 6) AS median_kwh, round(sum(delta_kwh * abs(delta_minutes)) / sum(delta_kwh), 6) AS weighted_minutes, round(avg(abs(delta_minutes)), 6) AS mean_minutes, round(quantile_cont(abs(delta_minutes), 0.5), 6) AS median_minutes FROM tb GROUP BY city"),
    "l10_emissions_savings": _mt("SELECT city, round(sum(-da) / 1e6, 9) AS saved_avg_t, round(sum(-dm) / 1e6, 9) AS saved_marg_t FROM mt GROUP BY city UNION ALL SELECT 'ALL', round(sum(-da) / 1e6, 9), round(sum(-dm) / 1e6, 9) FROM mt"),
    "l11_time_histogram": _tb(", r AS (SELECT 'origin' AS role, original_time AS t FROM tb UNION ALL SELECT 'destination', proposed_shift_time FROM tb) SELECT role, isodow(t)::INT AS weekday, hour(t)::INT AS hour, count(*) AS n FROM r GROUP BY ALL"),
    "l12_customer_week_stats": _mt(", w AS (SELECT ca_id, city, isoyear(day)::INT AS iso_year, week(day)::INT AS iso_week, sum(moved_kwh) AS k, sum(-dm) AS s FROM mt GROUP BY ALL) SELECT city, iso_year, iso_week, count(*) AS customers, round(avg(k), 6) AS mean_kwh, round(quantile_cont(k, 0.5), 6) AS median_kwh, round(avg(s), 6) AS mean_saved_g FROM w GROUP BY ALL"),
    "l13_hour_pairs": _tb("SELECT hour(original_time)::INT AS origin, hour(proposed_shift_time)::INT AS destination, count(*) AS moves, round(sum(delta_kwh), 6) AS kwh, round(sum(md), 6) AS grams FROM tb GROUP BY ALL"),
    "l14_weekday_hour_flow": _tb(", r AS (SELECT 'out' AS role, original_time AS t, delta_kwh AS k, mb AS g FROM tb UNION ALL SELECT 'in', proposed_shift_time, delta_kwh, ma FROM tb), d AS (SELECT role, t::DATE AS day, hour(t)::INT AS hour, sum(k) AS k, sum(g) AS g FROM r GROUP BY ALL) SELECT role, isodow(day)::INT AS weekday, hour, round(avg(k), 6) AS mean_kwh, round(avg(g), 6) AS mean_grams, count(*) AS days FROM d GROUP BY ALL"),
    "l15_pre_post_profile": sql(_MV + ", f AS (SELECT ca_id, city, day, t AS slot, -q AS q FROM mv UNION ALL SELECT ca_id, city, day, s, q FROM mv), g AS (SELECT ca_id, city, day, slot, sum(q) AS q FROM f GROUP BY ALL) SELECT (slot // 2)::INT AS hour, round(avg(value), 6) AS mean_before, round(avg(value + coalesce(q, 0)), 6) AS mean_after, round(sum(value + coalesce(q, 0)) - sum(value), 6) + 0.0 AS net_kwh FROM shift_input LEFT JOIN g USING (ca_id, city, day, slot) GROUP BY ALL", "shift_input", recursive=True),
    "l16_direction_by_hour": _tb("SELECT hour(original_time)::INT AS hour, count(*) FILTER (shift_direction = 'backward') AS backward, count(*) FILTER (shift_direction = 'forward') AS forward, count(*) FILTER (shift_direction = 'stay') AS stay FROM tb GROUP BY ALL"),
    "l17_quota_and_boundary": _tb(", d AS (SELECT ca_id, city, day, count(*) AS n, count(*) FILTER (abs(delta_minutes) = 120) AS e FROM tb GROUP BY ALL) SELECT city, round(avg((n >= 1)::INT), 6) AS days_at_cap, round(sum(e) / sum(n), 6) AS moves_at_edge FROM d GROUP BY city"),
    "l18_savings_disagreement": _mt("SELECT city, count(*) FILTER (dm < 0 AND da >= 0) AS customer_days, round(avg((dm < 0 AND da >= 0)::INT), 6) AS share, round(coalesce(sum(-dm) FILTER (dm < 0 AND da >= 0), 0), 6) AS marginal_g FROM mt GROUP BY city"),
    "l20_usage_hourly": sql("SELECT city, date_trunc('hour', date) AS hour, round(avg(value), 6) AS mean_value FROM readings GROUP BY ALL", "readings"),
    "l22_weekly_summary": _mt("SELECT isoyear(day) || '-W' || lpad(week(day)::VARCHAR, 2, '0') AS period, " + _RED + " FROM mt GROUP BY ALL UNION ALL SELECT 'TOTAL', " + _RED + " FROM mt"),
}

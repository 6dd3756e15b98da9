"""Operators against hand-computed answers and invariants."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.functions.columns import EARTH_KM
from wattloom.operators import grid as G
from wattloom.operators import joins as J
from wattloom.operators import mef as M
from wattloom.operators import quality as Q
from wattloom.operators import reports as R
from wattloom.operators import shift as S
from wattloom.operators import usage as U
from wattloom.operators import weather as W
from wattloom.plans.fixtures import Inputs

SF = "/root/testdata/sf0.001"


def hourly(spark, values, start="2024-01-01 00:00:00", key="a"):
    t0 = dt.datetime.fromisoformat(start)
    return spark.createDataFrame([(key, t0 + dt.timedelta(hours=i), v) for i, v in enumerate(values)], "k string, timestamp timestamp_ntz, v double")


def by_time(df, col="v"):
    return [r[col] for r in df.orderBy("timestamp").collect()]


def test_missing_days_are_filled(spark):
    rows = [(1, dt.datetime(2024, 1, d, 12), 2.0, "c") for d in (1, 2, 4)]
    df = spark.createDataFrame(rows, "ca_id int, date timestamp_ntz, value double, city string")
    week = U.extrapolate_period(df, "week").first()
    assert (week.observed, week.days_present, week.total, week.coverage) == (6.0, 3, 14.0, pytest.approx(3 / 7))
    assert U.extrapolate_period(df, "year").first().total == pytest.approx(62.0)


def test_top_share(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([10, 5, 5, 5, 1, 1, 1, 1, 1, 1])], "ca_id int, value double")
    assert U.top_share(df, 0.2).first().top_share == pytest.approx(15 / 31)


def test_null_runs_and_isolated(spark):
    df = hourly(spark, [None, 1.0, None, 2.0, None, None, 3.0])
    assert [(r.run_id, r.n) for r in Q.null_runs(df, "v", ["k"]).orderBy("run_id").collect()] == [(0, 1), (2, 1), (4, 2)]
    r = Q.isolated_nulls(df, "v", ["k"]).first()
    assert (r.nulls, r.isolated) == (4, 1)
    rep = Q.null_report(df, ["k"], ["v"]).first()
    assert (rep.nulls, rep.isolated, len(rep.gaps)) == (4, 1, 1)


def test_fills_are_audited(spark):
    df = hourly(spark, [1.0, None, 3.0, None, None, None, 5.0])
    filler = hourly(spark, [9.0] * 7).withColumnRenamed("v", "f")
    out = W.impute_isolated(df, ["v"], ["k"])
    assert by_time(out) == [1.0, 2.0, 3.0, None, None, None, 5.0]
    out = W.fill_long_gaps_from(out, filler, {"v": "f"}, ["k", "timestamp"], ["k"], 3)
    assert by_time(out) == [1.0, 2.0, 3.0, 9.0, 9.0, 9.0, 5.0]
    log = [[e["method"] for e in r[W.AUDIT]] for r in out.orderBy("timestamp").collect()]
    assert log == [[], ["avg_of_neighbors"], [], ["filled_long_gap"]] + [["filled_long_gap"]] * 2 + [[]]
    assert by_time(W.fill_hours_from(hourly(spark, [None, None]), filler, {"v": "f"}, ["k", "timestamp"])) == [9.0, None]


def test_guarded_fill(spark):
    assert by_time(W.fill_guarded(hourly(spark, [None, 1.0, None, 3.0, None]), ["v"], ["k"])) == [None, 1.0, 2.0, 3.0, None]
    assert by_time(W.fill_guarded(hourly(spark, [None, 1.0, None]), ["v"], ["k"], 60)) == [1.0, 1.0, 1.0]


def test_deaccumulate(spark):
    df = W.deaccumulate(hourly(spark, [7.0, 1.0, 3.0, 2.5, 6.0]), ["v"], ["k"])
    assert by_time(df, "v_increment") == [None, 1.0, 2.0, 0.0, 3.5]
    assert by_time(W.interval_columns(df, ["v"]), "v_interval") == [7.0, 1.0, 2.0, 0.0, 3.5]


@pytest.mark.parametrize("stamp", ["end", "start"])
def test_splits_conserve_mass(spark, stamp):
    values = [random.Random(i).random() for i in range(24)]
    df = hourly(spark, values)
    shaped = W.split_rate_shaped(df, ["v"], ["k"], stamp=stamp)
    assert shaped.count() == 48 and shaped.agg(F.sum("v")).first()[0] == pytest.approx(sum(values))
    even = W.split_even(df, ["v"], ["k"], stamp=stamp)
    assert even.agg(F.sum("v")).first()[0] == pytest.approx(sum(values[1:] if stamp == "end" else values[:-1]))


def test_wind_midpoint_wraps(spark):
    df = hourly(spark, [350.0, 10.0]).withColumn("s", F.lit(2.0))
    r = W.wind_midpoint(df, "s", "v", ["k"]).first()
    assert min(r.v, 360 - r.v) == pytest.approx(0.0, abs=1e-6)


def test_resample_half_hours(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * i), float(i), 1.0) for i in range(12)]
    out = G.resample_30min(spark.createDataFrame(rows, "timestamp timestamp_ntz, mw double, t double"), ["mw"], ["t"]).orderBy("timestamp").collect()
    assert [(r.timestamp.hour, r.timestamp.minute, r.mw, r.t) for r in out] == [(0, 30, 2.5, 6.0), (1, 0, 8.5, 6.0)]


def test_validated_join_raises(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    ok = spark.createDataFrame([(1, "x")], "k int, v string")
    assert J.validated_left_join(left, ok, ["k"]).count() == 2
    with pytest.raises(Exception, match="repeat"):
        J.validated_left_join(left, ok.union(ok), ["k"]).collect()


def test_nearest_by_cells_is_exact(spark, monkeypatch):
    rng = random.Random(1)
    pts = spark.createDataFrame([(i, rng.uniform(60, 100), rng.uniform(-5, 60)) for i in range(60)], "p int, lon double, lat double")
    refs = spark.createDataFrame([(i, rng.uniform(60, 100), rng.uniform(-5, 60)) for i in range(40)], "r int, lon double, lat double")
    want = {r.p: (r.r, round(r.distance, 6)) for r in J.nearest_location(pts, refs, "p", "r").collect()}
    monkeypatch.setattr(J, "FEW_REFERENCES", 5)
    got = {r.p: (r.r, round(r.distance, 6)) for r in J.nearest_location(pts, refs, "p", "r").collect()}
    assert got == want


@pytest.mark.parametrize("metric", ["haversine", "planar"])
def test_nearest_over_densities(spark, monkeypatch, metric):
    """Clusters of very different density, single far points, both sides of the date line, poles, ties and shared places."""
    rng = random.Random(3)
    around = lambda lon, lat, r, n: [(lon + rng.uniform(-r, r), lat + rng.uniform(-r, r)) for _ in range(n)]
    places = around(77, 28, 1e-4, 300) + around(77, 28, 1, 100) + around(-60, -20, 15, 60) + around(10, 60, 1e-9, 20)
    places += [(179.999, 1.0), (-179.999, 1.0), (0.0, 89.9), (180.0, 89.9), (5.0, 5.0), (5.0, 5.0), (0.0, 0.0)]
    refs = [(i, *x) for i, x in enumerate(places)]
    pts = [(i, *x) for i, x in enumerate(around(77, 28, 1e-3, 100) + around(-60, -20, 40, 60) + [(-179.998, 1.0), (179.9, 1.1), (90.0, 89.95), (5.0, 5.0), (1.0, 0.0), (120.0, -80.0)])]
    p, r = spark.createDataFrame(pts, "p int, lon double, lat double"), spark.createDataFrame(refs, "r int, lon double, lat double")
    want = {x.p: (x.r, x.distance) for x in J.nearest_location(p, r, "p", "r", metric).collect()}
    monkeypatch.setattr(J, "FEW_REFERENCES", 5)
    got = {x.p: (x.r, x.distance) for x in J.nearest_location(p, r, "p", "r", metric).collect()}
    assert got == want
    empty = J.nearest_location(p.where("p < 0"), r, "p", "r", metric)
    assert empty.count() == 0 and empty.columns == ["p", "lon", "lat", "r", "distance"]


def test_nearest_other_place(spark):
    """A city dense at every scale beside far outliers, in two groups, one of them null: each place's nearest other one."""
    from wattloom.operators import places

    rng = random.Random(4)
    dense = [(i, "ab"[i % 2] if i % 3 else None, 77 + rng.random() * 10 ** -rng.uniform(0, 7), 28 + rng.random() * 10 ** -rng.uniform(0, 7)) for i in range(1500)]
    rows = [*dense, (1500, "a", -120.0, -60.0), (1501, "b", 20.0, 70.0), (1502, "c", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, g string, lon double, lat double")
    got = {r.i: r.best.distance for r in places.nearest(df, df, ["g"], "i", "i", apart=True).collect()}
    assert set(got) == {r[0] for r in rows[:-1]}
    for g in ("a", "b", None):
        own = [r for r in rows if r[1] == g]
        lon, lat = np.radians([r[2] for r in own]), np.radians([r[3] for r in own])
        s, t = np.sin((lat[:, None] - lat) / 2), np.sin((lon[:, None] - lon) / 2)
        km = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, s * s + np.cos(lat)[:, None] * np.cos(lat) * t * t)))
        np.fill_diagonal(km, np.inf)
        assert [got[r[0]] for r in own] == pytest.approx(km.min(axis=1), rel=1e-6, abs=1e-9)


def test_factor_years(spark):
    t = spark.createDataFrame([(2001, 1.0), (2003, 3.0)], "year int, f double")
    got = {r.year: r.f for r in J.emission_factor_years(t, 2000, 2004).collect()}
    assert got == {2000: 1.0, 2001: 1.0, 2002: 3.0, 2003: 3.0, 2004: 3.0}


def model_rows(spark, n=400):
    rng = np.random.default_rng(0)
    rows = [("ab"[i % 2], "xy"[i % 4 // 2], float(q), float((2 + i % 2) * q + 0.5 * q * q + (3 if i % 4 // 2 else 0))) for i, q in enumerate(rng.uniform(0, 10, n))]
    return spark.createDataFrame(rows, "g string, s string, q double, y double").withColumn("q2", F.col("q") * F.col("q"))


def test_groupwise_ols_recovers_coefficients(spark):
    fits = M.groupwise_ols(model_rows(spark), "y", ["q", "q2"], ["g"], ["s"])
    got = {r.g: r for r in fits.collect()}
    for g, slope in (("a", 2.0), ("b", 3.0)):
        c = got[g].coefficients
        assert (c["q"], c["q2"], c["s=y"]) == (pytest.approx(slope, abs=1e-5), pytest.approx(0.5, abs=1e-5), pytest.approx(3.0, abs=1e-5))
        assert got[g].r2 == pytest.approx(1.0)
    me = M.groupwise_me(model_rows(spark), fits, "q", ["g"], "q", "q2").where("g = 'a'").first()
    assert pytest.approx(2 + me.q, abs=1e-4) == me.ME


def test_global_models_find_the_slope(spark):
    df = model_rows(spark).where("g = 'a' and s = 'x'")
    for model in (M.poly_ols(df, "q", "y", 2), M.poly_ridge(df, "q", "y", 2, alphas=(1e-6, 10.0)), M.poly_huber(df, "q", "y", 2), M.spline_fit(df, "q", "y", n=8, penalty=1e-6)):
        r = df.where("q between 2 and 8").agg(F.max(F.abs(model.me() - (2 + F.col("q")))), F.max(F.abs(model.predict() - F.col("y")))).first()
        assert r[0] < 0.05 and r[1] < 0.05, model


def test_huber_ignores_outliers(spark):
    df = model_rows(spark).where("g = 'a' and s = 'x'").withColumn("y", F.when(F.pmod(F.xxhash64("q"), F.lit(20)) == 0, F.col("y") + 500).otherwise(F.col("y")))
    r = df.agg(F.percentile(F.abs(M.poly_huber(df, "q", "y", 2).me() - (2 + F.col("q"))), F.lit(0.5))).first()
    assert r[0] < 0.5


def test_quantile_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(8)], "q double")
    edges = M.quantile_bins_fit(df, {"q": 4})["q"]
    assert edges == [-1e-4, 1.5, 3.5, 5.5, 7.0001]
    assert [r.q_bin for r in M.quantile_bins(df, {"q": edges}).collect()] == [1, 1, 2, 2, 3, 3, 4, 4]
    far = spark.createDataFrame([(-5.0,), (99.0,)], "q double")
    assert [r.q_bin for r in M.quantile_bins(far, {"q": edges}, "edge").collect()] == [0, 5]
    with pytest.raises(Exception, match="range"):
        M.quantile_bins(far, {"q": edges}, "error").collect()


def test_ramps_calibration_and_confidence(spark):
    rows = [("c", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * i), float(q), 1.0 + 2.0 * q, 0.5) for i, q in enumerate([0, 3, 1, 6, 2, 2])]
    df = spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, q double, y double, ME double")
    pairs = M.ramp_pairs(df, "q", "y", "ME")
    assert [r.s for r in pairs.collect()] == [2.0] * 4  # the last step has no ramp
    varied = pairs.withColumn("m", F.col("dq")).withColumn("s", 1 + 3 * F.col("m"))
    assert M.calibrate_wls(varied) == (pytest.approx(1.0), pytest.approx(3.0))
    table = spark.createDataFrame([(1.0, 0.3), (2.0, 0.5), (4.0, 0.7)], "tau double, r double")
    labels = M.confidence_label(spark.createDataFrame([(0.5,), (1.5,), (-2.5,), (9.0,)], "dq double"), table).collect()
    assert [x.confidence for x in labels] == ["low", "low", "medium", "high"]


def test_search_skips_done(spark):
    df = model_rows(spark)
    out = M.search_models(df, "y", "q", [{"q": 2}], [[]]).collect()
    assert len(out) == 1
    with pytest.raises(ValueError):
        M.search_models(df, "y", "q", [{"q": 2}], [[]], done=[out[0].config])


def test_preprocess_fits_on_train_only(spark):
    train, new = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(10)], "x double, c string"), spark.createDataFrame([(100.0, "z")], "x double, c string")
    p = M.Preprocess(winsorize=("x",), standardise=("x",), onehot=("c",)).fit(train)
    r = p.apply(new).first()
    assert r.x < 2 and r.c_b == 0


# --- shifting -----------------------------------------------------------------------------------------------------------


def week(spark, people=6, days=7, seed=3):
    rng = random.Random(seed)
    rows = []
    for p in range(people):
        for d in range(days):
            for s in range(48):
                rows.append((p, f"c{p % 2}", dt.date(2024, 1, 1) + dt.timedelta(days=d), s, round(rng.random() * 2, 3) if rng.random() < 0.6 else 0.0, 400.0 + 30 * ((s * 7 + d) % 11), 500.0 + s % 5))
    return spark.createDataFrame(rows, "ca_id int, city string, day date, slot int, value double, mef double, aef double")


def moves_of(df, policy, **kw):
    return sorted((r.ca_id, r.day, r.t, r.s, round(r.q, 9)) for r in S.shift_load(df, policy, **kw).collect())


def test_shift_invariants(spark):
    df = week(spark).withColumn("floor_kwh", F.lit(0.2))
    policy = S.Policy(moves_per_day=2, moves_per_week=5, window=5, regional_fraction=0.1, headroom=0.5)
    moves = S.shift_load(df, policy).cache()
    assert moves.count() > 0
    assert moves.where("abs(t - s) > 5 or mef_s >= mef_t or q <= 0").count() == 0
    assert moves.groupBy("ca_id", "day").count().where("count > 2").count() == 0
    assert moves.groupBy("ca_id").count().where("count > 5").count() == 0
    moved = {(r.city, r.day): r.q for r in moves.groupBy("city", "day").agg(F.sum("q").alias("q")).collect()}
    load = {(r.city, r.day): r.v for r in df.groupBy("city", "day").agg(F.sum("value").alias("v")).collect()}
    assert all(q <= 0.1 * load[k] + 1e-9 for k, q in moved.items())
    base = {(r.city, r.day, r.slot): r.baseline for r in S.city_slot_baseline(df).collect()}
    into = {(r.city, r.day, r.s): r.q for r in moves.groupBy("city", "day", "s").agg(F.sum("q").alias("q")).collect()}
    assert all(q <= 1.5 * base[k] + 1e-9 for k, q in into.items())
    after = S.optimised_readings(df, moves)
    assert after.agg(F.sum("optimised_value")).first()[0] == pytest.approx(df.agg(F.sum("value")).first()[0])
    sources = after.join(moves.select("ca_id", "day", F.col("t").alias("slot")), ["ca_id", "day", "slot"])
    assert sources.where("optimised_value < 0.2 - 1e-9").count() == 0


def test_reports_cover_all(spark):
    df = week(spark)
    moves = S.shift_load(df, S.PRESETS[2])
    out = R.run_all(S.moves_table(moves), S.shift_metrics(df, moves, S.PRESETS[2]))
    assert all(x.count() > 0 for x in out.values())
    total = out["overall_reduction"].where("city = 'TOTAL'").first()
    assert 0 < total.reduction_marg < 1
    bound = S.shift_upper_bound(df).agg(F.sum("saving_grams")).first()[0]
    assert total.baseline_marg_g - total.post_marg_g <= bound


def test_no_python_in_plain_operators(spark):
    df = week(spark)
    text = S.candidate_moves(df, 4)._jdf.queryExecution().toString()
    assert "Python" not in text and "CartesianProduct" not in text


def test_neighbours_far_dense_and_alone(spark):
    rng = random.Random(9)
    rows = [(i, "a", 77 + rng.random() * 0.01, 28 + rng.random() * 0.01) for i in range(600)]
    rows += [(600, "a", -120.0, -60.0), (601, "a", 77.0, 80.0), (602, "a", 77.0, 80.0), (700, "b", 1.0, 1.0), (701, "b", 179.9, 1.0), (800, "c", 5.0, 5.0), (801, "c", None, 5.0)]
    df = spark.createDataFrame(rows, "ca_id int, city string, lon double, lat double")

    def km(p, q):
        a, b, c, d = map(math.radians, (p[3], p[2], q[3], q[2]))
        return 2 * EARTH_KM * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    got = {r.city: r for r in J.neighbour_distances(df).collect()}
    for city in ("a", "b"):
        own = [r for r in rows if r[1] == city]
        best = [min(km(p, q) for q in own if q[0] != p[0]) for p in own]
        assert got[city].points == len(own)
        assert (got[city].mean_km, got[city].max_km, got[city].min_km) == (pytest.approx(sum(best) / len(best), rel=1e-3), pytest.approx(max(best), rel=1e-3), pytest.approx(min(best), rel=1e-6, abs=1e-9))
    assert "c" not in got


def test_factor_years_fill_gaps(spark):
    """A year without factors takes those of the next one that has them, years after the last those of the last."""
    table = spark.createDataFrame([(2019, 0.9, 0.4), (2021, 0.8, 0.3)], "year int, thermal_factor double, gas_factor double")
    got = {r.year: r.thermal_factor for r in J.emission_factor_years(table, 2018, 2023).collect()}
    assert got == {2018: 0.9, 2019: 0.9, 2020: 0.8, 2021: 0.8, 2022: 0.8, 2023: 0.8}


def test_candidate_moves_send_nothing_to_all(spark):
    """A customer-day pairs its own slots: a join would be sent whole to the driver, as its size is taken for that of the file."""
    df = week(spark).withColumn("floor_kwh", F.lit(0.2))
    rows = {(r.ca_id, r.day, r.slot): r for r in df.collect()}
    want = {(p, d, a.slot, b) for (p, d, _), a in rows.items() if a.value > 0.2 for b in range(max(0, a.slot - 4), min(47, a.slot + 4) + 1) if rows[p, d, b].mef < a.mef}
    for moves in (S.candidate_moves(df, 4), S.candidate_moves(df.groupBy(*S.KEYS).agg(F.sort_array(F.collect_list(F.struct("slot", "value", "mef", "aef", "floor_kwh"))).alias("slots")), 4)):
        got = [(r.ca_id, r.day, r.t, r.s) for r in moves.collect()]
        assert len(got) == len(want) and set(got) == want
        assert all(r.avail == pytest.approx(rows[r.ca_id, r.day, r.t].value - 0.2) for r in moves.collect())
        assert "Join" not in moves._jdf.queryExecution().toString()
    few = Inputs(spark, SF)
    for out in (S.candidate_moves(few.shift_days, 4), S.share_capped_greedy(few.shift_days, 4), few.shift_input):
        assert "Join" not in out._jdf.queryExecution().toString()


def test_equal_readings_of_a_day_have_equal_sums(spark):
    """0.1 + 0.2 + 0.3 isn't 0.3 + 0.2 + 0.1 in doubles: readings of a day are added up in time order, however they are stored."""
    rows = [(8, h, v) for h, v in ((1, 0.1), (2, 0.2), (3, 0.3))] + [(7, h, v) for h, v in ((3, 0.3), (2, 0.2), (1, 0.1))]
    rows = [(i, "view", dt.datetime(2024, 1, 8, h), v) for i, h, v in rows]
    df = spark.createDataFrame(rows, "ca_id long, city string, date timestamp_ntz, value double").coalesce(1)
    assert [(r.ca_id, r.kwh) for r in U.customer_order(df).orderBy("place").collect()] == [(7, 0.1 + 0.2 + 0.3), (8, 0.1 + 0.2 + 0.3)]
    assert {r.rank_share for r in U.rank_customers(df).collect()} == {0.75}


def test_readings_of_a_slot_are_added_up_in_time_order(spark, tmp_path):
    rows = [(1, "view", dt.datetime(2024, 1, 8, 0, m), v) for m, v in ((3, 0.3), (2, 0.2), (1, 0.1))]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    few = Inputs(spark, str(tmp_path))
    assert few.shift_used.first().slots[0].value == few.shift_days.first().slots[0].value == 0.1 + 0.2 + 0.3

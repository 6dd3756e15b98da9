"""shift_load against a greedy that goes through days, customers, moves, slots and destinations one by one."""

import random
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import moves_of, week
from wattloom.operators import shift as S
from wattloom.operators.greedy import Days, settled


def greedy(rows, policy):
    load, base, own = defaultdict(float), defaultdict(float), defaultdict(dict)
    for r in rows:
        load[r.city, r.day] += r.value
        base[r.city, r.day, r.slot] += r.value
        own[r.day, r.city, r.ca_id][r.slot] = r
    region = {k: float("inf") if policy.regional_fraction is None else (policy.regional_load or {}).get(k[0], v) * policy.regional_fraction for k, v in load.items()}
    cap = {k: float("inf") if policy.headroom is None else v * (1 + policy.headroom) for k, v in base.items()}
    after, used, out = defaultdict(float), defaultdict(int), []
    order = sorted(own, key=lambda k: (k[0], k[1], -sum(r.value for r in own[k].values()), k[2]))
    for day, city, who in order:
        slots = own[day, city, who]
        usage = {t: r.value for t, r in slots.items()}
        valid = {t for t, r in slots.items() if r.mef is not None and r.aef is not None and r.mef > 0 and r.aef > 0}
        peak = {}
        if policy.peak_fraction is not None:
            for h in policy.peak_hours.get(day.isoweekday(), ()):
                both = {2 * h: 2 * h, 2 * h + 1: 2 * h + 1} if policy.peak_per == "slot" else {2 * h: 2 * h, 2 * h + 1: 2 * h}
                for t, g in both.items():
                    peak[t] = g
        left = defaultdict(float)
        for t, g in peak.items():
            left[g] += policy.peak_fraction * slots[t].value
        room = {s: max(0.0, cap[city, day, s] - after[city, day, s] - slots[s].value) for s in slots}
        done = set()
        for _ in range(min(policy.moves_per_day, policy.moves_per_week - used[who])):
            best = None
            for t in sorted(valid - done):
                can = max(0.0, usage[t] - (getattr(slots[t], "floor_kwh", 0.0) if "floor_kwh" in slots[t] else 0.0))
                if t in peak:
                    can = min(can, left[peak[t]])
                for s in range(max(0, t - policy.window), min(47, t + policy.window) + 1):
                    if s in valid and slots[s].mef < slots[t].mef - 1e-12:
                        q = min(can, room[s], region[city, day])
                        gain = (slots[t].mef - slots[s].mef) * q
                        if q > 1e-12 and (best is None or gain > best[0]):
                            best = gain, t, s, q
            if best is None:
                break
            _, t, s, q = best
            usage[t] -= q
            usage[s] += q
            room[s] -= q
            region[city, day] = max(0.0, region[city, day] - q)
            if t in peak:
                left[peak[t]] -= q
            done.add(t)
            out.append((who, day, t, s, round(q, 9)))
        used[who] += len(done)
        for t, v in usage.items():
            after[city, day, t] += v
    return sorted(out)


PEAKS = {d: (8, 18, 19) for d in range(1, 6)}
POLICIES = {
    "one a day": S.Policy(moves_per_day=1, moves_per_week=3, window=4, regional_fraction=0.02),
    "two a day": S.Policy(moves_per_day=2, moves_per_week=3, window=4, regional_fraction=0.03),
    "no limit of the region": S.Policy(moves_per_day=3, moves_per_week=9, window=6, regional_fraction=None),
    "load given": S.Policy(moves_per_day=2, moves_per_week=5, window=3, regional_fraction=0.1, regional_load={"c0": 20.0}),
    "destinations": S.Policy(moves_per_day=2, moves_per_week=9, window=4, regional_fraction=0.9, headroom=0.02),
    "destinations and region": S.Policy(moves_per_day=2, moves_per_week=4, window=4, regional_fraction=0.04, headroom=0.1),
    "peak slots": S.Policy(moves_per_day=2, moves_per_week=9, window=6, regional_fraction=0.05, peak_hours=PEAKS, peak_fraction=0.3),
    "peak hours": S.Policy(moves_per_day=3, moves_per_week=9, window=6, regional_fraction=None, peak_hours=PEAKS, peak_fraction=0.4, peak_per="hour"),
}


def varied(spark):
    """Two cities with unequal households, slots without factors, floors and equal households."""
    rows, rng = [], random.Random(7)
    for r in week(spark, people=11).collect():
        scale = [1, 1, 1, 4, 0.3, 1, 9, 1, 1, 0, 2][r.ca_id]
        mef = None if rng.random() < 0.03 else r.mef
        rows.append((r.ca_id, r.city, r.day, r.slot, round(r.value * scale, 3), mef, -1.0 if rng.random() < 0.02 else r.aef, 0.1 if r.slot % 4 else None))
    out = spark.createDataFrame(rows, "ca_id int, city string, day date, slot int, value double, mef double, aef double, floor_kwh double")
    return out.withColumn("floor_kwh", F.coalesce("floor_kwh", F.lit(0.0)))


@pytest.mark.parametrize("name", POLICIES)
def test_moves_are_those_of_the_greedy(spark, name):
    df = varied(spark).cache()
    want = greedy(df.collect(), POLICIES[name])
    assert want and moves_of(df, POLICIES[name]) == want


@pytest.mark.parametrize("name", ["two a day", "destinations and region", "peak slots"])
def test_rounds_of_blocks_agree(spark, name):
    df = varied(spark).where("day < '2024-01-04'").cache()
    want = greedy(df.collect(), POLICIES[name])
    assert moves_of(df, POLICIES[name], task_rows=2) == want


def test_large_weeks_choose_once(spark):
    """Quotas of earlier days, peaks, and rooms that end in several blocks, with all policies in one pass and blocks of three."""
    df = varied(spark).where("day < '2024-01-05'").cache()
    names = [n for n, p in POLICIES.items() if p.headroom is None]
    some = [replace(POLICIES[n], name=n) for n in names]
    got = S.shift_scenarios(df, some, task_rows=3).collect()
    for p in some:
        assert sorted((r.ca_id, r.day, r.t, r.s, round(r.q, 9)) for r in got if r.policy == p.name) == greedy(df.collect(), p), p.name


def test_empty_and_useless_input(spark):
    df = week(spark, people=2, days=1)
    assert S.shift_load(df.where("false"), S.PRESETS[1]).count() == 0
    assert S.shift_load(df.withColumn("value", F.lit(0.0)), S.PRESETS[1]).count() == 0
    assert S.shift_load(df.withColumn("mef", F.lit(None).cast("double")), S.PRESETS[1]).count() == 0


def test_policies_in_one_pass(spark):
    df = varied(spark).cache()
    some = [S.Policy(n, **{f: getattr(POLICIES[n], f) for f in ("moves_per_day", "moves_per_week", "window", "peak_hours", "peak_fraction", "peak_per", "regional_fraction", "regional_load", "headroom")}) for n in ("one a day", "destinations", "peak hours")]
    got = S.shift_scenarios(df, some).collect()
    for p in some:
        assert sorted((r.ca_id, r.day, r.t, r.s, round(r.q, 9)) for r in got if r.policy == p.name) == greedy(df.collect(), p)
    with pytest.raises(ValueError):
        S.shift_scenarios(df, [some[0], some[0]])


def test_few_choices_where_destinations_have_limits():
    """Chunks adapt to conflicts, and the moves are those of one household after the other."""
    rng = np.random.default_rng(2)
    n = 1500
    value = rng.gamma(1.0, 1.0, (n, 48)) * rng.choice([0.2, 1, 3], (n, 1))
    days = Days(value[np.argsort(-value.sum(axis=1))], np.tile(rng.uniform(100, 900, 48), (n, 1)), np.zeros((n, 48)))
    for headroom in (0.0, 0.05):
        load, work = days.value.sum(axis=0) * (1 + headroom), []
        got, _, left = settled(days, np.full(n, 2), 4, 2, np.inf, load.copy(), [], None, work)
        assert sum(work) < 3 * n
        dest = load.copy()
        for i in range(n):
            one, _, dest = settled(days[i : i + 1], np.full(1, 2), 4, 2, np.inf, dest, [], None)
            assert (one.t == got.t[i]).all() and (one.s == got.s[i]).all() and np.allclose(one.q, got.q[i])
        assert np.allclose(dest, left)


def test_arrays_of_days_with_gaps(spark):
    rows = [(1, "a", t, float(t), 500.0 + t, 400.0) for t in range(48)] + [(2, "a", t, 1.0, 7.0, None) for t in (3, 40)]
    df = spark.createDataFrame(rows, "ca_id int, city string, slot int, value double, mef double, aef double").selectExpr("*", "date'2024-01-01' AS day")
    got = {r.ca_id: r for r in S.slot_arrays(df.repartition(5)).collect()}
    assert got[1].value == [float(t) for t in range(48)] and got[1].mef[47] == 547.0 and len(got[1].aef) == 48
    assert got[2].value == [1.0 if t in (3, 40) else 0.0 for t in range(48)] and got[2].mef == [7.0 if t in (3, 40) else None for t in range(48)] and got[2].aef == [None] * 48


def used_only(df):
    """Customer-days of readings with the slots in use only, and the factors of all slots, which are the city's."""
    factors = df.groupBy("city", "day", "slot").agg(F.max("mef").alias("mef"), F.max("aef").alias("aef"))
    dense = S.slot_arrays(factors.withColumns({"ca_id": F.lit(0), "value": F.lit(0.0)})).select("city", "day", "mef", "aef")
    slots = F.sort_array(F.collect_list(F.when((F.col("value") > 0) | (F.col("floor_kwh") > 0), F.struct("slot", "value", "floor_kwh"))))
    return df.groupBy(*S.KEYS).agg(slots.alias("slots")), dense


@pytest.mark.parametrize("task_rows", [3, 50_000])
def test_factors_of_a_city_beside_the_slots_in_use(spark, task_rows):
    """Slots without usage aren't carried along; the moves are those of whole days."""
    df = varied(spark).where("day < '2024-01-05'").withColumns({"mef": F.when(F.col("slot") % 7 > 0, 400.0 + 30 * ((F.col("slot") * 7 + F.dayofmonth("day")) % 11)), "aef": 500.0 + F.col("slot"), "value": F.when(F.col("slot") % 3 > 0, F.col("value")).otherwise(0.0)}).cache()
    days, factors = used_only(df)
    some = [replace(POLICIES[n], name=n) for n in ("two a day", "no limit of the region", "peak hours", "destinations and region")]
    got = S.shift_scenarios(days, some, task_rows, factors).collect()
    for p in some:
        want = greedy(df.collect(), p)
        assert want and sorted((r.ca_id, r.day, r.t, r.s, round(r.q, 9)) for r in got if r.policy == p.name) == want, p.name


def test_reports_on_customer_days_are_those_on_readings(spark):
    df = varied(spark).where("day < '2024-01-05'").withColumns({"mef": 400.0 + F.col("slot") % 11 * 30, "aef": 500.0 + F.col("slot")}).cache()
    moves = S.shift_load(df, POLICIES["two a day"]).cache()
    days, factors = used_only(df)
    rows = lambda x, c: sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x.select(*c).collect()], key=str)
    forms = [days.join(factors, ["city", "day"]), df.groupBy(*S.KEYS).agg(F.sort_array(F.collect_list(F.struct("slot", "value", "mef", "aef"))).alias("slots"))]
    want = S.shift_metrics(df, moves, POLICIES["two a day"])
    for d in forms:
        assert rows(S.shift_metrics(d, moves, POLICIES["two a day"]), want.columns) == rows(want, want.columns)
        after = S.optimised_readings(d, moves, with_value=True)
        assert rows(after, [*S.KEYS, "slot", "optimised_value"]) == rows(S.optimised_readings(df, moves), [*S.KEYS, "slot", "optimised_value"])
        assert rows(after, [*S.KEYS, "slot", "value"]) == rows(df, [*S.KEYS, "slot", "value"])
    whole = S.weighted_median_shift(moves).withColumnRenamed("median_abs_shift_minutes", "m")
    assert rows(want.where("moved_kwh > 0").select(*S.KEYS, F.col("median_shift_minutes_energy_weighted").alias("m")), [*S.KEYS, "m"]) == rows(whole, [*S.KEYS, "m"])


def test_first_weekdays_of_large_weeks_go_together(spark, monkeypatch):
    """Weekdays that the week's quota can't end in are one step, and a step writes no more than four tables."""
    df = varied(spark).cache()
    written, real = [], S.kept
    monkeypatch.setattr(S, "kept", lambda t, *by: written.append(t.columns) or real(t, *by))
    policy = POLICIES["one a day"]
    assert moves_of(df, policy, task_rows=3) == greedy(df.collect(), policy)
    days = df.select("day").distinct().count()
    assert days > policy.moves_per_week and sum("quota" not in c and "first" in c for c in written) <= days - policy.moves_per_week + 1
    assert len(written) <= 6 + 4 * (days - policy.moves_per_week + 1)


def test_readings_of_customer_days_are_dealt_once(spark):
    from wattloom.plans.fixtures import Inputs

    days = Inputs(spark, "/root/testdata/sf0.001").shift_used
    days.collect()
    assert days._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1

"""Load shifting: move a household's energy to cleaner half-hours under household, slot and regional limits.

Input: ca_id, city, day (date), slot (0-47), value (kWh), mef and aef (grams for a kWh), and, if there, floor_kwh.
Where it says so, also customer-days: ca_id, city, day, and slots, an array of structs of the rest in the order of the slots;
shift_metrics and optimised_readings also take them with mef and aef as arrays of 48 beside slots, which then need only the
slots in use, once each. Where all of a city share their factors, shift_load and shift_scenarios take such slots and a
table of factors: city, day, mef, aef (arrays of 48).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.columns import once, shift_direction
from wattloom.operators.greedy import CHUNK, LEAST, SLOTS, Days, Moves, chosen, settled
from wattloom.operators.ranks import placed, same
from wattloom.sources.io import kept, scratch

KEYS = ["ca_id", "city", "day"]


@dataclass(frozen=True)
class Policy:
    """Limits of a shifting policy.

    moves_per_day, moves_per_week: of a household. window: slots that a move may span. peak_hours: {weekday 1-7: hours};
    peak_fraction: share of the household's own usage of a peak slot (peak_per 'slot') or hour ('hour') that may leave it
    (None: no limit); other slots have no such limit. regional_fraction: share of regional_load[city] (kWh a day;
    default: the city's own load) that may move (None: all). headroom: how far above its baseline the usage of the city
    may rise in a destination slot by a move, counting what those before use after their moves and the own usage, but
    not those that come after (None: no limit).
    """

    name: str = "policy"
    moves_per_day: int = 2
    moves_per_week: int = 7
    window: int = 6
    peak_hours: dict[int, tuple[int, ...]] | None = None
    peak_fraction: float | None = None
    peak_per: str = "slot"
    regional_fraction: float | None = 0.8
    regional_load: dict[str, float] | None = None
    headroom: float | None = None

    def peaks(self, weekday: int) -> list[list[int]]:
        """Groups of peak slots of a weekday (1-7) that share one limit."""
        if self.peak_fraction is None or not self.peak_hours:
            return []
        hours = sorted(set(self.peak_hours.get(weekday, ())))
        return [[2 * h, 2 * h + 1] for h in hours] if self.peak_per == "hour" else [[t] for h in hours for t in (2 * h, 2 * h + 1)]


#: The limits of the two published policies.
PRESETS = {
    1: Policy("policy_1", moves_per_day=2, moves_per_week=7, window=6, regional_fraction=0.80),
    2: Policy("policy_2", moves_per_day=1, moves_per_week=3, window=4, regional_fraction=0.25),
}


def city_slot_baseline(df: DataFrame) -> DataFrame:
    return df.groupBy("city", "day", "slot").agg(F.sum("value").alias("baseline"))


def peak_targets(df: DataFrame, peak_hours: dict[int, Sequence[int]], fraction: float, per: str = "slot") -> DataFrame:
    """city, day, slot (or hour), room: kWh that may leave each peak slot or hour of the city's weekday."""
    rows = [(d, h) for d, hours in peak_hours.items() for h in hours]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, "dow int, hour int"))
    base = city_slot_baseline(df).withColumns({"dow": F.weekday("day") + 1, "hour": F.floor(F.col("slot") / 2).cast("int")}).join(table, ["dow", "hour"])
    return base.groupBy("city", "day", per).agg((F.sum("baseline") * fraction).alias("room"))


def _valid(mef: Column, aef: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x > 0)
    return F.coalesce(ok(mef) & ok(aef), F.lit(False))


def valid_slots(df: DataFrame) -> DataFrame:
    return df.withColumn("valid", _valid(F.col("mef"), F.col("aef")))


def _slots(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row for each customer-day with slots: its readings (slot and cols) in the order of the slots."""
    return df.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("slot", *cols))).alias("slots"))


def slot_arrays(df: DataFrame) -> DataFrame:
    """Dense arrays of 48 slots for each customer-day; absent slots are 0 usage and null factors. Whole days are taken as
    they are; only days with gaps look their slots up one by one."""
    cols = ["value", "mef", "aef"] + (["floor_kwh"] if "floor_kwh" in df.columns else [])
    days = _slots(df, cols)
    every = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    whole = F.col("slots.slot").cast("array<int>") == every

    def array(x: str) -> Column:
        absent = F.lit(0.0) if x in ("value", "floor_kwh") else F.lit(None).cast("double")
        found = lambda i: F.get(F.filter("slots", lambda e: e["slot"] == i), 0)[x]
        full = F.col(f"slots.{x}")
        full = F.transform(full, lambda v: F.coalesce(v, absent)) if x in ("value", "floor_kwh") else full
        return F.when(whole, full).otherwise(F.transform(every, lambda i: F.coalesce(found(i), absent)))

    return days.select(*KEYS, *(array(x).alias(x) for x in cols))


def k_highest_sources(df: DataFrame, k: int) -> DataFrame:
    """The k slots with usage of each customer-day that have the highest factor."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("mef"), "slot")
    return df.where(F.col("value") > 0).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def candidate_moves(df: DataFrame, window: int) -> DataFrame:
    """(source, destination) slots of a customer-day at most window apart, to a lower factor, from readings or
    customer-days: each customer-day pairs its own slots, with no join. Columns t, s, avail, mef_t, aef_t, mef_s, aef_s,
    gain."""
    return _candidates(_customer_days(df), window, KEYS)


def _candidates(days: DataFrame, window: int, keep: Sequence[str]) -> DataFrame:
    floor = _has_floor(days)
    avail = lambda e: F.greatest(F.lit(0.0), F.coalesce(e["value"], F.lit(0.0)) - (F.coalesce(e["floor_kwh"], F.lit(0.0)) if floor else F.lit(0.0)))
    ok = lambda e: _valid(e["mef"], e["aef"])
    fields = lambda a, b: {"t": a["slot"].cast("int"), "s": b["slot"].cast("int"), "avail": avail(a), "mef_t": a["mef"], "aef_t": a["aef"], "mef_s": b["mef"], "aef_s": b["aef"]}

    def pairs(slots: Column) -> Column:
        near = lambda a: F.filter(slots, lambda b: (b["mef"] < a["mef"]) & (F.abs(a["slot"] - b["slot"]) <= window) & ok(b))
        return F.flatten(F.transform(F.filter(slots, lambda a: (avail(a) > 0) & ok(a)), lambda a: F.transform(near(a), lambda b: F.struct(*(x.alias(n) for n, x in fields(a, b).items())))))

    # explode_outer keeps the optimizer from working the pairs out once more to see whether there are any
    out = days.select(*keep, F.explode_outer(once(F.col("slots"), pairs)).alias("m")).where("m is not null")
    return out.select(*keep, "m.*").withColumn("gain", (F.col("mef_t") - F.col("mef_s")) * F.col("avail"))


#: Customer-days of a city and week that one task takes; larger ones go in blocks of so many.
TASK_ROWS = 50_000
_OUT = "t int, s int, q double, mef_t double, mef_s double, aef_t double, aef_s double"


def _customer_days(df: DataFrame) -> DataFrame:
    """One row for each customer-day of readings or customer-days with its slots, week, weekday (1-7) and usage."""
    days = df if "slots" in df.columns else _slots(df, [x for x in ("value", "mef", "aef", "floor_kwh") if x in df.columns])
    kwh = F.aggregate("slots", F.lit(0.0), lambda a, e: a + F.coalesce(e["value"], F.lit(0.0)))
    return days.select(*KEYS, F.trunc("day", "week").alias("week"), (F.weekday("day") + 1).alias("weekday"), kwh.alias("kwh"), "slots")


def _has_floor(days: DataFrame) -> bool:
    return "floor_kwh" in days.schema["slots"].dataType.elementType.names


def _dense(g: pa.Table | pa.RecordBatch) -> tuple[Days, np.ndarray]:
    """(days of the rows of g, average factors), spread from lists of slots without Python objects. Usage that a slot has
    twice adds up; factors are NaN where not both are finite and positive."""
    col = g.column("slots")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    row, entries = pc.list_parent_indices(col).to_numpy(), pc.list_flatten(col)
    names = [f.name for f in entries.type]
    field = lambda x: entries.field(x).to_numpy(zero_copy_only=False).astype(np.float64)
    used = lambda x: np.nan_to_num(field(x), nan=0.0, posinf=np.inf, neginf=-np.inf) if entries.field(x).null_count else field(x)
    at, n = row * SLOTS + entries.field("slot").to_numpy(), g.num_rows * SLOTS
    out = {"floor": np.zeros(n), "mef": np.full(n, np.nan), "aef": np.full(n, np.nan)}
    apart = "mef" in g.column_names
    for c in ("mef", "aef"):
        out[c][slice(None) if apart else at] = pc.list_flatten(g.column(c)).to_numpy(zero_copy_only=False) if apart else field(c)
    ok = np.isfinite(out["mef"]) & np.isfinite(out["aef"]) & (out["mef"] > 0) & (out["aef"] > 0)
    out["mef"][~ok] = out["aef"][~ok] = np.nan
    if "floor_kwh" in names:
        out["floor"][at] = used("floor_kwh")
    value = np.bincount(at, used("value"), n)
    shape = (g.num_rows, SLOTS)
    return Days(value.reshape(shape), out["mef"].reshape(shape), out["floor"].reshape(shape)), out["aef"].reshape(shape)


def _rows(g: pa.Table | pa.RecordBatch, days: Days, aef: np.ndarray, moves: Moves, also: Sequence[str] = ()) -> pa.Table:
    """The moves, in the order of the rows of g, with their customer-day and the columns also of g."""
    i, k = np.nonzero(moves.q > 0)
    t, s = moves.t[i, k], moves.s[i, k]
    at = pa.array(i)
    rest = {"t": pa.array(t.astype(np.int32)), "s": pa.array(s.astype(np.int32)), "q": moves.q[i, k], "mef_t": days.mef[i, t], "mef_s": days.mef[i, s], "aef_t": aef[i, t], "aef_s": aef[i, s]}
    return pa.table({c: g.column(c).take(at) for c in [*KEYS, *also]} | rest)


def _region(policy: Policy, city: str, load: float) -> float:
    return np.inf if policy.regional_fraction is None else policy.regional_fraction * (policy.regional_load or {}).get(city, load)


def _in_order(g: pa.Table) -> pa.Table:
    return g.take(pc.sort_indices(g.select(["kwh", "ca_id"]), [("kwh", "descending"), ("ca_id", "ascending")]))


def _week_moves(g: pa.Table, policies: Sequence[Policy]) -> pa.Table:
    """The moves of a whole city and week, day by day, under each policy; the days' arrays are made once."""
    g = g.append_column("who", pc.dictionary_encode(g.column("ca_id").combine_chunks()).indices)
    used = np.zeros((len(policies), g.num_rows), np.int64)
    parts = []
    for date in pc.unique(g.column("day")).sort():
        day = _in_order(g.filter(pc.equal(g.column("day"), date)))
        days, aef = _dense(day)
        who, load = day.column("who").to_numpy(), days.value.sum(axis=0)
        for policy, spent in zip(policies, used, strict=True):
            quota = np.minimum(policy.moves_per_day, policy.moves_per_week - spent[who])
            dest = None if policy.headroom is None else (1 + policy.headroom) * load
            region = _region(policy, day.column("city")[0].as_py(), float(day.column("kwh").to_numpy().sum()))
            moves, _, _ = settled(days, quota, policy.window, policy.moves_per_day, region, dest, policy.peaks(day.column("weekday")[0].as_py()), policy.peak_fraction)
            spent[who] += (moves.q > 0).sum(axis=1)
            out = _rows(day, days, aef, moves)
            parts.append(out.append_column("policy", pa.array([policy.name] * out.num_rows, pa.string())))
    return pa.concat_tables(parts)


def shift_scenarios(df: DataFrame, policies: Sequence[Policy], task_rows: int = TASK_ROWS, factors: DataFrame | None = None) -> DataFrame:
    """The moves of several policies (see shift_load), with the policy's name: readings are gathered once, and each task
    goes through all policies. Names of policies must differ."""
    if len({p.name for p in policies}) < len(policies):
        raise ValueError("policies need names of their own")
    with scratch() as keep:
        days = kept(_customer_days(df))
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in days.select(*KEYS).schema) + ", " + _OUT
        days = days.where("city is not null and day is not null")
        sizes = kept(days.groupBy("city", "week").count())
        if factors is not None:
            # written apart and joined where they are used: 96 numbers a row are slow to write and read
            factors = kept(factors.select("city", "day", "mef", "aef"))
            days = days.join(factors, ["city", "day"])
        # at most a row for each task_rows customer-days
        large = F.broadcast(sizes.where(F.col("count") > task_rows).select("city", "week"))
        small = days
        parts = []
        if not large.isEmpty():
            small, big = days.join(large, ["city", "week"], "left_anti"), days.join(large, ["city", "week"], "left_semi")
            own = [p for p in policies if p.headroom is None]
            if own:
                parts.append(_by_prefix(big, own, task_rows))
            if len(own) < len(policies):
                big = kept(big)
                parts += [_in_rounds(big, p, task_rows, kind).withColumn("policy", F.lit(p.name)) for p in policies if p.headroom is not None]
        if not parts or not sizes.where(F.col("count") <= task_rows).isEmpty():
            parts.append(small.groupBy("city", "week").applyInArrow(lambda g: _week_moves(g, policies), kind + ", policy string"))
        return keep(kept(reduce(DataFrame.unionByName, parts)))


def shift_load(df: DataFrame, policy: Policy, task_rows: int = TASK_ROWS, factors: DataFrame | None = None) -> DataFrame:
    """The moves of a policy: ca_id, city, day, t, s, q (kWh), mef and aef of both slots.

    Greedy: the days of a week come one after the other, and in a day the households of a city by descending usage, then
    id. Each takes up to moves_per_day moves, as long as its weekly quota lasts: always the one of the largest gain,
    which is the difference of the marginal factors times what can move (see greedy.chosen); of equal gains the earliest
    t, then s. Room in the region and at the destinations that one household takes is gone for those after it, and who
    finds too little takes the move that is then best. Only moves count towards the quota. Slots without two positive
    factors take no part.

    A city and week of up to task_rows customer-days is settled in one task. Larger ones without headroom choose all at
    once, as if alone (see _by_prefix); with headroom they go day by day in blocks of so many, and only the rooms go on to
    the next block. The moves are written, as reports read them several times.
    """
    return shift_scenarios(df, [policy], task_rows, factors).drop("policy")


#: Customer-days with moves of a block that is gone through again where the room of its region ends.
BLOCK_ROWS = 4_096


def _by_prefix(days: DataFrame, policies: Sequence[Policy], task_rows: int) -> DataFrame:
    """The moves of cities and weeks of any size under policies without headroom.

    What a customer-day takes alone does not depend on others, and a smaller quota takes the first of those moves: they
    are chosen once for all, where the days are, and only they are put in the order of a city's day. Everyone keeps theirs
    as long as their sum is within the region's room. Sums of blocks find the first block beyond it; the slots of that one
    are looked up and it is settled in one task, and so on with what it leaves. Days without moves of their own have none
    with less room. The first weekdays, as far as the quota of the week can't end in them, go together; the others follow
    one another, as quotas do.
    """
    size, by_name = min(task_rows, BLOCK_ROWS), {p.name: p for p in policies}
    key, who = ["policy", "city", "day"], ["policy", "ca_id", "city", "week"]
    place = F.struct("less", "ca_id")
    fields = {f.name: f.dataType.simpleString() for f in days.schema}
    cols = [f.strip().split(" ")[0] for f in _OUT.split(",")]
    keys = ", ".join(f"{c} {fields[c]}" for c in KEYS)

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each customer-day with moves, of each policy."""
        for b in batches:
            for weekday in pc.unique(b.column("weekday")).to_pylist():
                today = b.filter(pc.equal(b.column("weekday"), weekday))
                for lo in range(0, today.num_rows, 4 * CHUNK):
                    g = today.slice(lo, 4 * CHUNK)
                    x, aef = _dense(g)
                    for p in policies:
                        got = chosen(x, np.full(g.num_rows, p.moves_per_day), p.window, p.moves_per_day, np.full(g.num_rows, np.inf), None, p.peaks(weekday), p.peak_fraction)
                        n = (got.q > 0).sum(axis=1)
                        flat = _rows(g, x, aef, got).select(cols).combine_chunks()
                        entries = pa.StructArray.from_arrays([flat.column(c).combine_chunks() for c in cols], cols)
                        ends = np.append(0, np.cumsum(n[n > 0])).astype(np.int32)
                        some = {c: g.column(c).filter(pa.array(n > 0)) for c in [*KEYS, "week", "weekday", "kwh"]}
                        yield from pa.table(some | {"moves": pa.ListArray.from_arrays(ends, entries), "policy": pa.array([p.name] * (len(ends) - 1), pa.string())}).to_batches()

    def block(g: pa.Table) -> pa.Table:
        """The moves of a block, and a row with the room that it leaves."""
        g = _in_order(g)
        x, aef = _dense(g)
        p = by_name[g.column("policy")[0].as_py()]
        moves, room, _ = settled(x, g.column("quota").to_numpy(), p.window, p.moves_per_day, g.column("room")[0].as_py(), None, p.peaks(g.column("weekday")[0].as_py()), p.peak_fraction)
        out = _rows(g, x, aef, moves, ["week", "policy", "block"])
        out = out.append_column("room", pa.nulls(out.num_rows, pa.float64()))
        rest = {c: g.column(c).slice(0, 1) for c in [*KEYS, "week", "policy", "block"]} | {"room": pa.array([room])}
        return pa.concat_tables([out, pa.table({f.name: rest.get(f.name, pa.nulls(1, f.type)) for f in out.schema})])

    entry = ", ".join(f.strip().replace(" ", ": ") for f in _OUT.split(","))
    alone = kept(days.mapInArrow(free, f"{keys}, week {fields['week']}, weekday int, kwh double, moves array<struct<{entry}>>, policy string"))
    order = [*key, "less", "ca_id"]
    dealt = alone.withColumn("less", -F.col("kwh")).drop("kwh").repartitionByRange(*order).sortWithinPartitions(*order)
    own = kept(dealt.withColumn("block", F.floor(F.monotonically_increasing_id() / size)))
    load = kept(days.groupBy("city", "day", "weekday").agg(F.sum("kwh").alias("load")))

    def region(p: Policy) -> Column:
        if p.regional_fraction is None:
            return F.lit(float("inf"))
        given = F.create_map(*(F.lit(x) for kv in p.regional_load.items() for x in kv))[F.col("city")] if p.regional_load else F.lit(None)
        return p.regional_fraction * F.coalesce(given.cast("double"), F.col("load"))

    rooms = load.select("city", "day", "weekday", F.inline(F.array(*(F.struct(F.lit(p.name).alias("policy"), region(p).alias("room")) for p in policies))))
    limit = lambda f: F.create_map(*(F.lit(x) for p in policies for x in (p.name, getattr(p, f))))[F.col("policy")]
    done: list[DataFrame] = []

    def with_left(df: DataFrame) -> DataFrame:
        """df with the moves of the day that the quota of the week leaves."""
        if not done:
            return df.withColumn("left", F.least(limit("moves_per_day"), limit("moves_per_week")))
        spent = reduce(DataFrame.unionByName, done).groupBy(*who).agg(F.count("*").alias("spent"))
        left = F.least(limit("moves_per_day"), limit("moves_per_week") - F.coalesce("spent", F.lit(0))).cast("int")
        return kept(same(df, spent, who, "left").withColumn("left", left).drop("spent"))

    weekdays = sorted(r.weekday for r in load.select("weekday").distinct().collect())
    free_days = max(1, min(p.moves_per_week // max(1, p.moves_per_day) for p in policies))
    for some in filter(None, [weekdays[:free_days], *([w] for w in weekdays[free_days:])]):
        of_day = F.col("weekday").isin(some)
        today = days.where(of_day).withColumn("less", -F.col("kwh"))
        now = with_left(own.where(of_day).drop("weekday")).where("left > 0").withColumn("moves", F.slice("moves", 1, F.col("left")))
        now = now.withColumn("q", F.aggregate("moves", F.lit(0.0), lambda a, m: a + m["q"]))
        sums = now.groupBy(*key, "block").agg(F.sum("q").alias("q"), F.min(place).alias("lo"), F.max(place).alias("hi"))
        state, parts = rooms.where(of_day).select(*key, "room", F.lit(-1).cast("long").alias("first")), []
        while True:
            run = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
            all_ = same(sums, state, key).where("block > first").withColumn("all", F.sum("q").over(run))
            short = F.col("all") > F.col("room") + LEAST
            ends = F.min_by(F.when(short, F.struct("block", "lo", "hi")), F.when(short, F.col("block"))).alias("bad")
            cut = kept(all_.groupBy(*key, "room", "first").agg(ends, F.coalesce(F.max(F.when(~short, F.col("all"))), F.lit(0.0)).alias("took")))
            fine = same(now, F.broadcast(cut.select(*key, "first", F.col("bad.block").alias("bad"))), key).where("block > first and (bad is null or block < bad)")
            parts.append(fine.select(*KEYS, F.inline("moves"), "week", "policy").select(*KEYS, *cols, "week", "policy"))
            bad = F.broadcast(cut.where("bad is not null").select(*key, "bad.*", F.greatest(F.lit(0.0), F.col("room") - F.col("took")).alias("room")))
            if bad.isEmpty():
                break
            rows = same(today, bad, ["city", "day"]).where(place.between(F.col("lo"), F.col("hi"))).drop("lo", "hi", "less")
            quotas = same(now, bad.select(*key, "block"), [*key, "block"]).select("policy", *KEYS, F.col("left").cast("int").alias("quota"))
            rows = same(rows, quotas, ["policy", *KEYS])
            one = kept(rows.groupBy(*key).applyInArrow(block, f"{keys}, week {fields['week']}, policy string, block bigint, {_OUT}, room double"))
            parts.append(one.where("q is not null").select(*KEYS, *cols, "week", "policy"))
            state = one.where("q is null").select(*key, "room", F.col("block").alias("first")).where(F.col("room") > LEAST)
            if state.isEmpty():
                break
            if len(parts) == 2:
                sums = kept(sums)
        done.append(kept(reduce(DataFrame.unionByName, parts)))
    return reduce(DataFrame.unionByName, done).drop("week")


def _in_rounds(days: DataFrame, policy: Policy, task_rows: int, kind: str) -> DataFrame:
    """The moves of cities and weeks of any size under a policy with headroom, by rounds over blocks of customer-days."""
    out = None
    spent = lambda m: m.groupBy("ca_id", "city", F.trunc("day", "week").alias("week")).agg(F.count("*").alias("spent"))
    for weekday in sorted(r.weekday for r in days.select("weekday").distinct().collect()):
        today = days.where(F.col("weekday") == weekday)
        today = today.withColumn("spent", F.lit(0)) if out is None else today.join(spent(out), ["ca_id", "city", "week"], "left")
        left = F.least(F.lit(policy.moves_per_day), policy.moves_per_week - F.coalesce("spent", F.lit(0))).cast("int")
        with scratch() as keep:
            now = keep(_day_in_rounds(today.withColumn("quota", left).drop("spent"), policy, weekday, task_rows, kind))
        out = now if out is None else out.unionByName(now)
    return out


def _rooms(today: DataFrame, policy: Policy) -> DataFrame:
    """city, day, region (kWh that may move), dest (usage that each slot may take)."""
    key = ["city", "day"]
    slots = today.select(*key, F.inline("slots")).groupBy(*key, "slot").agg(F.sum("value").alias("v"))
    dest = F.array(*(F.coalesce(F.sum(F.when(F.col("slot") == i, F.col("v"))), F.lit(0.0)) * (1 + (policy.headroom or 0)) for i in range(SLOTS)))
    out = slots.groupBy(*key).agg(F.sum("v").alias("load"), dest.alias("dest"))
    regional = F.lit(float("inf"))
    if policy.regional_fraction is not None:
        given = F.create_map(*(F.lit(x) for kv in policy.regional_load.items() for x in kv))[F.col("city")] if policy.regional_load else F.lit(None)
        regional = policy.regional_fraction * F.coalesce(given.cast("double"), F.col("load"))
    return out.select(*key, regional.alias("region"), "dest")


def _day_in_rounds(today: DataFrame, policy: Policy, weekday: int, task_rows: int, kind: str) -> DataFrame:
    peaks, rounds, key = policy.peaks(weekday), policy.moves_per_day, ["city", "day"]

    def block(g: pa.Table) -> pa.Table:
        """The moves of a block, and a row with the rooms that it leaves."""
        g = _in_order(g)
        x, aef = _dense(g)
        dest = None if policy.headroom is None else np.array(g.column("dest")[0].as_py(), np.float64)
        moves, region, dest = settled(x, g.column("quota").to_numpy(), policy.window, rounds, g.column("region")[0].as_py(), dest, peaks, policy.peak_fraction)
        out, rooms = _rows(g, x, aef, moves), pa.list_(pa.float64())
        none = pa.nulls(out.num_rows)
        out = out.append_column("region", none.cast(pa.float64())).append_column("dest", none.cast(rooms))
        rest = {c: g.column(c).slice(0, 1) for c in KEYS} | {"region": pa.array([region]), "dest": pa.array([[] if dest is None else dest.tolist()], rooms)}
        return pa.concat_tables([out, pa.table({f.name: rest.get(f.name, pa.nulls(1, f.type)) for f in out.schema})])

    ranked = placed(today.withColumn("_one", F.lit(1).cast("long")), key, [F.desc("kwh"), "ca_id"], "_one")
    numbered = ranked.withColumn("block", F.floor(F.col("below") / task_rows).cast("int")).drop("_one", "below", "total")
    open_, state, done = kept(numbered, ["block"]), kept(_rooms(today, policy)), []
    settle = lambda rows: kept(rows.groupBy(*key).applyInArrow(block, kind + ", region double, dest array<double>"))
    rooms = lambda one: kept(one.where("q is null").select(*key, "region", "dest"))
    moved = lambda one: one.where("q is not null").drop("region", "dest")
    # each block is read once, from a folder of its own
    for n in range((open_.agg(F.max("block")).first()[0] or 0) + 1):
        one = settle(open_.where(F.col("block") == n).join(state, key))
        done.append(moved(one))
        state = rooms(one)
    out = done[0]
    for m in done[1:]:
        out = out.unionByName(m)
    return kept(out)


def shift_upper_bound(df: DataFrame) -> DataFrame:
    """Each customer-day with all valid energy in its slot of the least factor: the largest saving there can be."""
    ok = valid_slots(df).where("valid")
    out = ok.groupBy(*KEYS).agg(
        F.sum("value").alias("kwh"), F.sum(F.col("value") * F.col("mef")).alias("baseline_grams"), F.min("mef").alias("least_mef"), F.min_by("slot", F.struct("mef", "slot")).alias("slot")
    )
    return out.withColumn("bound_grams", F.col("kwh") * F.col("least_mef")).withColumn("saving_grams", F.col("baseline_grams") - F.col("bound_grams"))


def moves_table(moves: DataFrame) -> DataFrame:
    """Times, minutes, direction, and grams before and after of each move."""
    at = lambda slot: F.timestamp_add("MINUTE", (F.col(slot) * 30).cast("int"), F.col("day").cast("timestamp_ntz")).cast("timestamp_ntz")
    minutes = (F.col("s") - F.col("t")) * 30
    cols = [*KEYS, at("t").alias("original_time"), at("s").alias("proposed_shift_time"), minutes.alias("delta_minutes"), shift_direction(minutes).alias("shift_direction"), F.col("q").alias("delta_kwh")]
    for name, x in (("marginal", "mef"), ("average", "aef")):
        before, after = F.col("q") * F.col(f"{x}_t"), F.col("q") * F.col(f"{x}_s")
        cols += [before.alias(f"{name}_emissions_before_shift_grams_co2"), after.alias(f"{name}_emissions_after_shift_grams_co2"), (after - before).alias(f"{name}_emissions_delta_grams_co2")]
    return moves.select(*cols)


def emissions_totals(df: DataFrame, by: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Grams by average and marginal factor, over factors that are finite and positive, of readings or customer-days."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x > 0)
    grams = lambda v, x: F.when(ok(x), v * x).otherwise(0.0)
    if "slots" not in df.columns:
        return df.groupBy(*by).agg(F.sum("value").alias("baseline_kwh"), *(F.sum(grams(F.col("value"), F.col(x))).alias(f"baseline_E_{n}_g") for x, n in (("aef", "avg"), ("mef", "marg"))))
    factor = lambda e, x: F.get(F.col(x), e["slot"]) if x in df.columns else e[x]
    # the slots of a customer-day are added up in its row
    day = lambda f: F.aggregate("slots", F.lit(0.0), lambda a, e: a + F.coalesce(f(e), F.lit(0.0)))
    sums = {"baseline_kwh": day(lambda e: e["value"]), "baseline_E_avg_g": day(lambda e: grams(e["value"], factor(e, "aef"))), "baseline_E_marg_g": day(lambda e: grams(e["value"], factor(e, "mef")))}
    days = df.select(*by, *(x.alias(n) for n, x in sums.items()))
    return days if list(by) == KEYS else days.groupBy(*by).agg(*(F.sum(n).alias(n) for n in sums))


def weighted_median_shift(moves: DataFrame, by: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Energy-weighted median of |s - t| x 30: the first distance at which half of the energy is reached."""
    d = moves.groupBy(*by, (F.abs(F.col("s") - F.col("t")) * 30).alias("m")).agg(F.sum("q").alias("q"))
    w = Window.partitionBy(*by)
    cum = d.withColumns({"c": F.sum("q").over(w.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("q").over(w)})
    return cum.where(F.col("c") >= 0.5 * F.col("all") - 1e-12).groupBy(*by).agg(F.min("m").alias("median_abs_shift_minutes"))


def _median_of_day() -> Column:
    """weighted_median_shift of the few moves of a customer-day, as an aggregate."""
    moves = F.array_sort(F.collect_list(F.struct((F.abs(F.col("s") - F.col("t")) * 30).alias("m"), "q")))
    half = 0.5 * F.sum("q") - 1e-12
    step = lambda a, e: F.struct((a["c"] + e["q"]).alias("c"), F.coalesce(a["m"], F.when(a["c"] + e["q"] >= half, e["m"])).alias("m"))
    return F.aggregate(moves, F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("int").alias("m")), step)["m"]


def shift_metrics(df: DataFrame, moves: DataFrame, policy: Policy) -> DataFrame:
    """Base and shifted emissions, moved kWh, mean and median shift, quota used and left, of each customer-day."""
    delta = lambda x: F.sum(F.col("q") * (F.col(f"{x}_s") - F.col(f"{x}_t")))
    m = moves.groupBy(*KEYS).agg(
        delta("aef").alias("delta_E_avg_g"), delta("mef").alias("delta_E_marg_g"), F.sum("q").alias("moved_kwh"), F.count("*").alias("moves"),
        (F.sum(F.col("q") * F.abs(F.col("s") - F.col("t")) * 30) / F.sum("q")).alias("avg_shift_minutes_energy_weighted"),
        _median_of_day().alias("median_shift_minutes_energy_weighted"),
    )
    out = emissions_totals(df).join(m, KEYS, "left")
    zero = {x: F.coalesce(x, F.lit(0.0)) for x in ("delta_E_avg_g", "delta_E_marg_g", "moved_kwh")} | {"moves": F.coalesce("moves", F.lit(0))}
    out = out.withColumns(zero).withColumns({f"post_E_{n}_g": F.col(f"baseline_E_{n}_g") + F.col(f"delta_E_{n}_g") for n in ("avg", "marg")})
    week = Window.partitionBy("ca_id", "city", F.trunc("day", "week")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum("moves").over(week)
    return out.withColumns({"post_kwh": F.col("baseline_kwh"), "weekly_moves_used": used, "weekly_moves_remaining": policy.moves_per_week - used}).drop("moves")


def day_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("city", "day").agg(F.count("*").alias("n_customers_solved"), F.sum("moved_kwh").alias("moved_kwh_day_sum")).withColumn("row_type", F.lit("day_summary"))


def optimised_readings(df: DataFrame, moves: DataFrame, with_value: bool = False) -> DataFrame:
    """Usage of each slot less what left it and with what came; slots without readings come in when energy moves there.
    with_value: also the usage before, 0 where there was no reading. Customer-days meet their moves as one row each."""
    flows = moves.select(*KEYS, F.explode(F.array(F.struct(F.col("t").alias("slot"), (-F.col("q")).alias("q")), F.struct(F.col("s").alias("slot"), F.col("q").alias("q")))).alias("f")).select(*KEYS, "f.*")
    value, flow = F.coalesce("value", F.lit(0.0)), F.coalesce("_d", F.lit(0.0))
    if "slots" in df.columns:
        known = lambda xs, v: F.map_from_entries(F.transform(xs, lambda e: F.struct(e["slot"].cast("int"), e[v])))
        sums = flows.groupBy(*KEYS, "slot").agg(F.sum("q").alias("q"))
        sums = sums.groupBy(*KEYS).agg(F.collect_list(F.struct("slot", "q")).alias("_flows"))
        days = df.select(*KEYS, known(F.col("slots"), "value").alias("_used")).join(sums.select(*KEYS, known(F.col("_flows"), "q").alias("_moved")), KEYS, "full")
        own = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<int>"))
        every = F.sequence(F.lit(0), F.lit(SLOTS - 1)) if "mef" in df.columns else F.array_union(own("_used"), own("_moved"))
        rows = days.select("*", F.explode(every).alias("slot"))
        out = rows.withColumns({"value": F.col("_used")[F.col("slot")], "_d": F.col("_moved")[F.col("slot")]})
    else:
        flows = flows.groupBy(*KEYS, "slot").agg(F.sum("q").alias("_d"))
        out = df.select(*KEYS, "slot", "value").join(flows, [*KEYS, "slot"], "full")
    return out.select(*KEYS, "slot", *([value.alias("value")] if with_value else []), (value + flow).alias("optimised_value"))


def share_capped_greedy(df: DataFrame, window: int, max_share: float = 0.2, trigger_share: float = 0.01) -> DataFrame:
    """Simple policy: slots by descending factor, each to the cheapest slot in its window, until max_share of the day's
    energy has moved; only slots with at least trigger_share of it move."""
    day = Window.partitionBy(*KEYS)
    c = _candidates(_customer_days(df), window, [*KEYS, "kwh"]).where(F.col("avail") >= trigger_share * F.col("kwh"))
    c = c.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS, "t").orderBy("mef_s", F.abs(F.col("s") - F.col("t")), "s"))).where("_r = 1")
    before = F.coalesce(F.sum("avail").over(day.orderBy(F.desc("mef_t"), "t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    q = F.least("avail", F.greatest(F.lit(0.0), max_share * F.col("kwh") - before))
    return c.withColumn("q", q).where("q > 0").select(*KEYS, "t", "s", "q", "mef_t", "mef_s", "aef_t", "aef_s")


def scenario_metrics(df: DataFrame, moves: DataFrame) -> DataFrame:
    """Moved kWh, its share of all, and kWh moved forward and backward, by policy."""
    total = F.broadcast(df.agg(F.sum("value").alias("_all")))
    out = moves.groupBy("policy").agg(
        F.sum("q").alias("moved_kwh"), F.sum(F.when(F.col("s") > F.col("t"), F.col("q")).otherwise(0.0)).alias("forward_kwh"), F.sum(F.when(F.col("s") < F.col("t"), F.col("q")).otherwise(0.0)).alias("backward_kwh")
    )
    return out.crossJoin(total).withColumn("share_moved", F.col("moved_kwh") / F.col("_all")).drop("_all")

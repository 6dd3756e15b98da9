"""Embedding near-dedup by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import connected_components, discard, fresh_key, integer_ids, stash, temporary, whole_groups

#: Rows of one side of a comparison task.
BLOCK = 2048
#: Passes and windows that are tried for a label; the cheapest that keep the expected share of missed pairs below the
#: bound. A label for which none does gets as many passes as it takes, or all its pairs in blocks if that is cheaper.
PASSES = (1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
WINDOWS = (128, 512, 2048, 8192)
#: Passes over which the order of a label is measured.
TRIALS = 2
#: Comparisons that cost about as much as moving a vector once more.
MOVE = 1000
#: Passes that are made at once; the scratch of these goes before the next ones are made.
AT_ONCE = 32


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the unit vectors of each label (part) in a task."""
    sums: dict[int, np.ndarray] = {}
    for f in frames:
        for part, own in f.groupby("part"):
            sums[part] = sums.get(part, 0.0) + np.append(_unit(own["v"]).sum(axis=0), len(own))
    yield pd.DataFrame({"part": pd.Series(list(sums), dtype="int64"), "x": pd.Series(list(sums.values()), dtype=object)})


def _keys(f: pd.DataFrame, p: int, seed: int) -> np.ndarray:
    """The 64 signs, by random planes of pass p, of unit vectors less the mean of their label."""
    d = _unit(f["v"]) - np.stack(f["mean"].to_numpy())
    planes = np.random.default_rng((seed, p, d.shape[1])).standard_normal((d.shape[1], 64))
    bits = (d @ planes > 0).astype(np.uint64) << np.arange(63, -1, -1, dtype=np.uint64)
    # shifted so that signed order is that of the bits
    return (bits.sum(axis=1, dtype=np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _by_size(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, own in f.groupby("size_"):
        yield own


def agreement(spread: np.ndarray, threshold: float) -> np.ndarray:
    """Chance that a sign is the same for a vector and one at the threshold. spread: the vector's squared distance from
    its label's mean, from which the angle between the two, seen from the mean, follows."""
    return 1 - np.arccos(np.clip(1 - (1 - threshold) / np.maximum(spread, 1e-12), -1, 1)) / np.pi


def _trials(frames: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """Sort keys of the passes on trial, with the vectors' squared distances from the mean."""
    for f in frames:
        for own in _by_size(f):
            spread = ((_unit(own["v"]) - np.stack(own["mean"].to_numpy())) ** 2).sum(axis=1)
            for p in range(TRIALS):
                yield pd.DataFrame({"pass": p, "part": own["part"], "key": _keys(own, p, seed), "spread": spread, "n": own["n"]})


def _ahead(frames: Iterator[pd.DataFrame], windows: tuple[int, ...]) -> Iterator[pd.DataFrame]:
    """Of sorted rows, counts by label, window, distance from the mean (in hundredths) and how many leading signs the row
    has in common with the one a window further on (64: the whole label is in a window). Where that one is in another
    task, it has as many as if rows were spread evenly."""
    counts: dict[tuple, int] = {}
    longest = max(windows)
    held, of = None, None

    def count(f: pd.DataFrame, upto: int) -> None:
        key = f["key"].to_numpy().view(np.uint64)
        bucket = np.clip(np.ceil(100 * f["spread"].to_numpy()[:upto]), 1, 400).astype(int)
        size = int(f["n"].iloc[0])
        for w in windows:
            n = max(0, min(upto, len(f) - w))
            same = np.full(upto, 64 if size <= w else math.ceil(math.log2(size / w)))
            if size > w:
                # leading zeros, by the exponent of the 53 leading bits as a float
                other = ((key[:n] ^ key[w : w + n]) >> np.uint64(11)).astype(np.float64)
                same[:n] = np.where(other == 0, 53, 52 - np.floor(np.log2(np.maximum(other, 1))))
            for (b, s), c in zip(*(x.tolist() for x in np.unique(np.stack([bucket, same], axis=1), axis=0, return_counts=True)), strict=True):
                k = of[1], w, b, s
                counts[k] = counts.get(k, 0) + c

    for f in frames:
        for at, own in f.groupby(["pass", "part"], sort=False):
            if of == at:
                held = pd.concat([held, own], ignore_index=True)
            else:
                if held is not None:
                    count(held, len(held))
                held, of = own.reset_index(drop=True), at
            if len(held) > 4 * longest:
                count(held, len(held) - longest)
                held = held.iloc[len(held) - longest :].reset_index(drop=True)
    if held is not None:
        count(held, len(held))
    yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["part", "window", "bucket", "same", "n"])


def _least_passes(near: np.ndarray, c: np.ndarray, miss: float, most: int) -> int | None:
    """The least number of passes up to most that misses a share of at most miss; near: chance of a pair in one pass."""
    missed = lambda p: float((c * (1 - near) ** p).sum() / c.sum())
    if missed(most) > miss:
        return None
    lo, hi = 0, most
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if missed(mid) <= miss else (mid, hi)
    return hi


def plans(trials: DataFrame, threshold: float, miss: float, windows: tuple[int, ...] = WINDOWS, most_passes: int = PASSES[-1]) -> DataFrame:
    """part, window, passes: for each label the cheapest window and number of passes with which, by the order measured, at
    most a share of miss of the pairs at the threshold is in no window. If no window does in most_passes: more passes,
    or, if these cost more than all pairs in blocks, none (passes 0), which stands for the blocks.

    A pair is in a window at least when it agrees in one sign more than rows a window apart do.
    """
    n = trials.groupBy("part", "window", "bucket", "same").agg(F.sum("n").alias("n"))

    def chosen(f: pd.DataFrame) -> pd.DataFrame:
        near = np.where(f["same"] >= 64, 1.0, agreement(f["bucket"].to_numpy() / 100, threshold) ** (f["same"].to_numpy() + 1))
        sides = [(int(w), near[at], f["n"].to_numpy()[at]) for w in sorted(f["window"].unique()) for at in [(f["window"] == w).to_numpy()]]
        options = []
        for w, x, c in sides:
            p = next((p for p in PASSES if p <= most_passes and (c * (1 - x) ** p).sum() / c.sum() <= miss), None)
            options += [(p * (MOVE + w), w, p)] if p else []
        if not options:
            size = sides[0][2].sum() / TRIALS
            blocks = size * (0.5 + MOVE / BLOCK)
            options = [(blocks, sides[0][0], 0)]
            for w, x, c in sides:
                p = _least_passes(x, c, miss, int(blocks // (MOVE + w)))
                options += [(p * (MOVE + w), w, p)] if p else []
        _, window, passes = min(options)
        return pd.DataFrame({"part": f["part"].iloc[:1], "window": [window], "passes": [passes]})

    return n.groupBy("part").applyInPandas(chosen, "part long, window int, passes int")


def _keyed(frames: Iterator[pd.DataFrame], seed: int, first: int, end: int) -> Iterator[pd.DataFrame]:
    """Each class once for each pass of its label from first up to end, with the pass's 64 signs as a sort key."""
    for f in frames:
        for own in _by_size(f):
            for p in range(first, min(end, int(own["passes"].max()))):
                x = own[own["passes"] > p]
                yield pd.DataFrame({"pass": p, "part": x["part"], "key": _keys(x, p, seed), "cid": x["cid"], "window": x["window"], "v": x["v"]})


def _linked(u: np.ndarray, cid: np.ndarray, old: int, window: int, threshold: float) -> pd.DataFrame:
    """Verified links of the rows from old on with the window rows before each, which join all that are linked."""
    at = np.arange(len(u))
    near = u[old:] @ u.T >= threshold
    near &= (at[None, :] < at[old:, None]) & (at[old:, None] - at[None, :] <= window)
    i, j = _forest(near, old)
    return pd.DataFrame({"a": cid[i], "b": cid[j]})


def _forest(near: np.ndarray, old: int) -> tuple[np.ndarray, np.ndarray]:
    """The least links that join all that near joins: rows (counted from old) and columns of those, in order, whose ends
    no earlier one joins."""
    root, kept = np.arange(near.shape[1]), []
    for i in np.flatnonzero(near.any(axis=1)):
        to = np.flatnonzero(near[i])
        # one link to each tree that the row isn't in yet
        trees, first = np.unique(root[to], return_index=True)
        other = trees != root[old + i]
        kept += [(old + i, j) for j in to[first[other]]]
        root[np.isin(root, trees[other])] = root[old + i]
    out = np.array(kept, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


_LINKS = "a long, b long, task int, pass int, part long, window int, head boolean, nth int, cid long, v array<{}>"
_BORDER = ["task", "pass", "part", "window", "head", "nth", "cid", "v"]


def _linked_in_windows(frames: Iterator[pd.DataFrame], threshold: float, task: int = 0) -> Iterator[pd.DataFrame]:
    """From the sorted rows of a task, links of rows with those in their windows; and, marked with the task's number, its
    first and its last window, whose neighbours are in other tasks. Held are one window and a batch."""
    held: tuple | None = None  # (pass, part), unit vectors and ids of the last window, its rows
    heads, head, needed = [], None, 0

    def border(f: pd.DataFrame, first: bool) -> pd.DataFrame:
        return f.assign(a=None, b=None, task=task, head=first, nth=np.arange(len(f)))[["a", "b", *_BORDER]]

    for f in frames:
        for at, own in f.groupby(["pass", "part"], sort=False):
            window = int(own["window"].iloc[0])
            same = held is not None and held[0] == at
            if head is None:
                head, needed = at, window
            if needed and at == head:
                heads.append(own.iloc[:needed])
                needed -= len(heads[-1])
            for lo in range(0, len(own), 512):
                rows = own.iloc[lo : lo + 512]
                u, cid, old = _unit(rows["v"]), rows["cid"].to_numpy(), 0
                if same:
                    u, cid, rows, old = np.concatenate([held[1], u]), np.concatenate([held[2], cid]), pd.concat([held[3], rows]), len(held[1])
                yield _linked(u, cid, old, window, threshold).assign(**dict.fromkeys(_BORDER))
                held, same = (at, u[-window:], cid[-window:], rows.iloc[-window:]), True
    if heads:
        yield border(pd.concat(heads), True)
        yield border(held[3], False)


def _over_borders(g: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the last window of a task and the first of the next, if they are of one pass and label."""
    g = g.sort_values(["head", "nth"])
    tail, head = g[~g["head"]], g[g["head"]]
    if not len(tail) or not len(head) or tail["pass"].iloc[0] != head["pass"].iloc[0] or tail["part"].iloc[0] != head["part"].iloc[0]:
        return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    both = pd.concat([tail, head])
    return _linked(_unit(both["v"]), both["cid"].to_numpy(), len(tail), int(g["window"].iloc[0]), threshold)


def _linked_in_blocks(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Links of the rows of one block of a label with those of another, which join all that are linked."""
    for g in whole_groups(frames, ["part", "i", "j"]):
        g = g.sort_values("block", kind="stable")
        u, block, cid = _unit(g["v"]), g["block"].to_numpy(), g["cid"].to_numpy()
        old = int((block < g["j"].iloc[0]).sum())
        near = u[old:] @ u.T >= threshold
        # within a block each pair once, else only pairs of both
        near &= np.arange(len(u)) < (np.arange(old, len(u))[:, None] if old == 0 else old)
        i, j = _forest(near, old)
        yield pd.DataFrame({"a": cid[i], "b": cid[j]})


def _counted(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Weights of the links of each row with the rows of the other block of its task."""
    for g in whole_groups(frames, ["component", "i", "j"]):
        u, block = _unit(g["v"]), g["block"].to_numpy()
        w, cid, i, j = g["size"].to_numpy(), g["cid"].to_numpy(), g["i"].iloc[0], g["j"].iloc[0]
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = u[a] @ u[b].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            yield pd.DataFrame({"cid": cid[a], "links": near @ w[b]})
        else:
            yield pd.DataFrame({"cid": np.concatenate([cid[a], cid[b]]), "links": np.concatenate([near @ w[b], near.T @ w[a]])})


def embedding_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.93, miss: float = 1e-6, seed: int = 9, windows: tuple[int, ...] = WINDOWS,
    most_passes: int = PASSES[-1],
) -> DataFrame:
    """One row for each row of df: id, n_links, component_id, kept, class_id.

    Vectors are compared within a label by cosine in double precision. Equal vectors of a label are one class. In
    each pass the classes are ordered by the signs of 64 random projections of the unit vectors less their label's
    mean, and each is compared with the rows in the window before it, over the borders of tasks as well; of the verified
    links of a piece all are kept that the others don't replace. The links of all passes make components. Each label has
    its own window and number of passes, from an order measured over all its rows (plans()), so that a pair at the
    threshold is expected to be missed at a rate of miss; a label for which the largest window and most_passes don't do
    gets more passes, or all its pairs in blocks, whichever costs less. Within the components, classes are compared in blocks of 2,048 rows a side, and only counts of links
    leave a task: n_links has no cap, however large a group of near copies is.

    Null labels (where a label column is given), null and empty vectors, zero vectors and those with null, NaN or
    infinite components link with nothing. Vectors of different length don't link. Rows that repeat an id count as
    vectors of their own. Rows with null id link with nothing. An empty table gives an empty result. Other columns
    are not read. Ids are integers.
    """
    integer_ids(df, id_col)
    with temporary() as keep:
        spark = df.sparkSession
        real = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
        v = F.transform(F.col(vector_col), lambda x: x.cast(real) + F.lit(0.0).cast(real))
        label = F.col(label_col).cast("string") if label_col else F.lit("")
        rows = df.select(F.col(id_col).alias("id"), label.alias("label"), v.alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        rows = rows.withColumn("good", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False)))
        rows = keep(stash(rows.withColumn("size_", F.size("v")).withColumn("part", F.xxhash64("label", "size_")), "vectors"))
        classes = rows.where("good").groupBy("label", "v").agg(F.min("id").cast("long").alias("cid"), F.count("*").alias("size"), F.first("part").alias("part"), F.first("size_").alias("size_"))
        classes = keep(stash(classes, "classes"))

        sums = classes.select("part", "v").mapInPandas(_sums, "part long, x array<double>").select("part", F.posexplode("x").alias("at", "x"))
        sums = sums.groupBy("part", "at").agg(F.sum("x").alias("x")).groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("x"))
        means = stash(sums.select("part", F.element_at("x", -1).cast("long").alias("n"), F.transform(F.slice("x", 1, F.size("x") - 1), lambda x: x / F.element_at("x", -1)).alias("mean")), "means")
        centred = classes.select("part", "cid", "size_", "v", fresh_key("part").alias("k")).join(means.withColumn("k", fresh_key("part")), ["k", "part"]).drop("k")

        partitions = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        trials = centred.select("part", "size_", "v", "mean", "n").mapInPandas(lambda f: _trials(f, seed), "pass int, part long, key long, spread double, n long")
        trials = trials.repartitionByRange(partitions, "pass", "part", "key").sortWithinPartitions("pass", "part", "key")
        plan = stash(plans(trials.mapInPandas(lambda f: _ahead(f, windows), "part long, window int, bucket int, same int, n long"), threshold, miss, windows), "plans")

        planned = centred.withColumn("k", fresh_key("part")).join(plan.withColumn("k", fresh_key("part")), ["k", "part"]).select("part", "cid", "size_", "v", "mean", "n", "window", "passes")
        moved = means.select("part", "n").join(plan, "part").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
        passes, once, window, blocks = moved.agg(
            F.max("passes"), F.sum(F.col("n") * F.least("passes", F.lit(AT_ONCE))), F.max("window"), F.sum(F.when(F.col("passes") == 0, F.col("n") * F.col("blocks")))
        ).first()
        parts = max(1, min(partitions, (once or 0) // (8 * (window or 1))))
        links = stash(spark.createDataFrame([], "a long, b long"), "links")
        if blocks:
            dense = planned.where("passes = 0").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
            dense = dense.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "cid"), F.col("blocks")))
            dense = dense.select("part", "cid", "v", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
            dense = dense.select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "v")
            dense = dense.repartition(max(partitions, blocks // (16 * BLOCK)), "part", "i", "j").sortWithinPartitions("part", "i", "j", "cid")
            links = stash(dense.mapInPandas(lambda f: _linked_in_blocks(f, threshold), "a long, b long").distinct(), "links")
        for lo in range(0, passes or 0, AT_ONCE):
            keyed = planned.where(F.col("passes") > lo).select("part", "cid", "size_", "v", "mean", "window", "passes")
            keyed = keyed.mapInPandas(lambda f, lo=lo: _keyed(f, seed, lo, lo + AT_ONCE), f"pass int, part long, key long, cid long, window int, v array<{real}>")
            dealt = keyed.repartitionByRange(parts, "pass", "part", "key").sortWithinPartitions("pass", "part", "key", "cid")
            found = stash(dealt.mapInPandas(lambda f: _linked_in_windows(f, threshold, TaskContext.get().partitionId()), _LINKS.format(real)), "links")
            ends = found.where("task is not null")
            before = ends.select("task").distinct().withColumn("edge", F.lag("task").over(Window.orderBy("task")))
            ends = ends.join(F.broadcast(before), "task").withColumn("edge", F.when(F.col("head"), F.col("edge")).otherwise(F.col("task"))).where("edge is not null")
            over = ends.groupBy("edge").applyInPandas(lambda g: _over_borders(g, threshold), "a long, b long")
            fresh = found.where("task is null").select("a", "b").union(over)
            old, links = links, stash(fresh.union(links).distinct(), "links")
            discard(found, old)
        found = keep(stash(connected_components(links), "found"))

        member = classes.withColumn("k", fresh_key("cid")).join(found.select(F.col("node").alias("cid"), "component", fresh_key("node").alias("k")), ["k", "cid"])
        sizes = member.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        member = member.select("cid", "component", "size", "v", fresh_key("component").alias("k")).join(sizes.withColumn("k", fresh_key("component")), ["k", "component"])
        member = member.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "cid"), F.col("blocks")))
        tasks = member.select("cid", "component", "size", "v", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        tasks = tasks.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "size", "v")
        tasks = tasks.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "cid")
        counted = tasks.mapInPandas(lambda frames: _counted(frames, threshold), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))

        groups = classes.select("label", "v", "cid", "size").withColumn("k", fresh_key("cid"))
        groups = groups.join(found.select(F.col("node").alias("cid"), "component", fresh_key("node").alias("k")), ["k", "cid"], "left").join(counted.withColumn("k", fresh_key("cid")), ["k", "cid"], "left")
        groups = groups.select("label", "v", "cid", F.coalesce("component", "cid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), fresh_key("label", "v").alias("k"))
        out = rows.withColumn("k", F.when(F.col("good"), fresh_key("label", "v"))).join(groups, ["k", "label", "v"], "left")
        component = F.coalesce("component", "id")
        return out.select(
            F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.coalesce("cid", "id").alias("class_id")
        )


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

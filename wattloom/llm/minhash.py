"""MinHash near-dedup on HyperMinHash registers, with verified links and exact components over all candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import connected_components, fresh_key, integer_ids, intersections, mixed, set_digest, shingles, stash, temporary, whole_groups, word_hashes

#: Buckets of a sketch; a register has 6 bits for the count of leading zeros and 10 of mantissa; four make a band.
BUCKETS, MANTISSA, ROWS = 128, 10, 4
BANDS = BUCKETS // ROWS
#: Classes of one side of a block.
BLOCK = 64


def _borrowing_order() -> np.ndarray:
    """For each bucket a seeded order of all buckets, itself first, in which it looks for a value while it is empty."""
    keys = mixed(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(1 << 40)).reshape(BUCKETS, BUCKETS)
    np.fill_diagonal(keys, 0)
    return keys.argsort(axis=1)


_ORDER = _borrowing_order()


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of an ascending set of 64-bit hashes that isn't empty.

    The top bits of a hash choose its bucket. Of the least other bits in a bucket the register keeps the number of
    leading zeros and the bits after the first one. Empty buckets take the register of the first filled one in an
    order of their own (densification), so that small sets have as many comparable registers as large ones.
    """
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    bucket = (s >> shift).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
    low = (s[first] << np.uint64(64) - shift) | np.uint64(1)
    zeros = 63 - np.floor(np.log2(low.astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 53)
    tail = (low << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    full = np.zeros(BUCKETS, bool)
    out = np.zeros(BUCKETS, np.uint16)
    full[bucket[first]] = True
    out[bucket[first]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | tail).astype(np.uint16)
    return out[_ORDER[np.arange(BUCKETS), full[_ORDER].argmax(axis=1)]]


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of n and m elements agree: same leading zeros, same mantissa."""
    z = np.arange(54)
    p = [np.exp(-x[:, None] / BUCKETS * 2.0 ** -(z + 1)) - np.exp(-x[:, None] / BUCKETS * 2.0**-z) for x in (np.maximum(n, BUCKETS), np.maximum(m, BUCKETS))]
    return (p[0] * p[1]).sum(axis=1) / 2**MANTISSA


def estimated(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketches (rows of uint16 registers), corrected for registers that agree by chance."""
    same = (a == b).mean(axis=1)
    c = chance(n, m)
    return np.clip((same - c) / (1 - c), 0, 1)


def sketches(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n (size of the shingle set), h0, h1 (digest of the set), bands (four registers each; empty without shingles)."""

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for t in f["text"]:
                s = shingles(word_hashes(t), words)
                h = set_digest(s)
                rows.append((len(s), *h, registers(s).view(np.int64) if len(s) else np.empty(0, np.int64)))
            yield pd.DataFrame({"id": f["id"], "n": [r[0] for r in rows], "h0": [r[1] for r in rows], "h1": [r[2] for r in rows], "bands": pd.Series([r[3] for r in rows], index=f.index, dtype=object)})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(made, f"id {kind}, n long, h0 long, h1 long, bands array<long>")


def _plausible(pairs: DataFrame, classes: DataFrame, threshold: float, margin: float) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose estimated similarity isn't far below it."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bands").alias(f"s_{x}"), fresh_key("cid").alias(f"k_{x}"))
    both = pairs.withColumn("k_a", fresh_key("a")).join(side("a"), ["k_a", "a"]).withColumn("k_b", fresh_key("b")).join(side("b"), ["k_b", "b"])
    both = both.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (threshold - 1e-9))

    def likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                a, b = (np.stack(f[c].to_numpy()).astype(np.int64).view(np.uint16) for c in ("s_a", "s_b"))
                yield f.loc[estimated(a, b, f["n_a"].to_numpy(), f["n_b"].to_numpy()) >= threshold - margin, ["a", "b"]]

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInPandas(likely, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of the full shingle sets. texts: cid, text."""
    side = lambda x: texts.select(F.col("cid").alias(x), F.col("text").alias(f"t_{x}"), fresh_key("cid").alias(f"k_{x}"))
    both = pairs.withColumn("k_a", fresh_key("a")).join(side("a"), ["k_a", "a"]).withColumn("k_b", fresh_key("b")).join(side("b"), ["k_b", "b"])

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, of = None, None  # pairs with the same b often follow each other
        for f in frames:
            keep = []
            for b, t, u in zip(f["b"], f["t_a"], f["t_b"], strict=True):
                if b != known:
                    known, of = b, shingles(word_hashes(u), words)
                s = shingles(word_hashes(t), words)
                both = len(np.intersect1d(s, of, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(of) - both))
            yield f.loc[keep, ["a", "b"]]

    return both.select("a", "b", "t_a", "t_b").mapInPandas(linked, "a long, b long")


def _open_pairs(a: pd.DataFrame, b: pd.DataFrame, threshold: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of pairs of different components that sizes and sketches allow to be linked."""
    na, nb = a["n"].to_numpy(), b["n"].to_numpy()
    small, large = np.minimum.outer(na, nb), np.maximum.outer(na, nb)
    i, j = np.nonzero((a["component"].to_numpy()[:, None] != b["component"].to_numpy()[None, :]) & (small >= large * (threshold - 1e-9)))
    if not len(i):
        return i, j
    sa, sb = (np.stack(x["bands"].to_numpy()).astype(np.int64).view(np.uint16) for x in (a, b))
    likely = estimated(sa[i], sb[j], na[i], nb[j]) >= threshold - margin
    return i[likely], j[likely]


def _likely_across(frames: Iterator[pd.DataFrame], threshold: float, margin: float) -> Iterator[pd.DataFrame]:
    """Of blocks of classes, the rows that may be linked with a row of the other side."""
    for g in whole_groups(frames, ["hub", "i", "j"]):
        a, b = g[g["first"]], g[~g["first"]]
        i, j = _open_pairs(a, b, threshold, margin)
        if len(i):
            yield pd.concat([a.iloc[np.unique(i)], b.iloc[np.unique(j)]])


def _linked_across(frames: Iterator[pd.DataFrame], words: int, percent: int, margin: float) -> Iterator[pd.DataFrame]:
    """From blocks of classes, links between rows of the first side and rows of other components, one for each
    component that a row links with."""
    for g in whole_groups(frames, ["hub", "i", "j"]):
        a, b = g[g["first"]], g[~g["first"]]
        i, j = _open_pairs(a, b, percent / 100, margin)
        if not len(i):
            continue
        na, nb = a["n"].to_numpy(), b["n"].to_numpy()
        ua, ub = np.unique(i), np.unique(j)
        sets = [shingles(word_hashes(t), words) for t in [*a["text"].iloc[ua], *b["text"].iloc[ub]]]
        if len(i) <= 32:
            at_a, at_b = np.searchsorted(ua, i), len(ua) + np.searchsorted(ub, j)
            both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(at_a, at_b, strict=True)])
        else:
            both = intersections(sets, len(ua))[np.searchsorted(ua, i), np.searchsorted(ub, j)]
        yes = 100 * both >= percent * (na[i] + nb[j] - both)
        out = pd.DataFrame({"a": a["cid"].to_numpy()[i[yes]], "b": b["cid"].to_numpy()[j[yes]], "component": b["component"].to_numpy()[j[yes]]})
        yield out.drop_duplicates(["a", "component"])[["a", "b"]]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, margin: float = 0.2) -> DataFrame:
    """One row for each row of df: id, n_shingles, component_id (smallest id reachable by links), kept, class_id.

    Rows with the same shingle set are one class (class_id: its smallest id). A class has a HyperMinHash sketch, cut
    into 32 bands of four registers; classes that share a band are candidates. First each class is compared with the
    smallest one (the hub) of each of its bands. Classes with a common hub hold all other candidate pairs: where they
    are of more than one component, those outside the largest component are compared with all of other components,
    in blocks of 64 by 64 of which only links leave a task. So no candidate link between components is missed, and
    thousands of copies cost about one comparison each. A comparison first bounds the similarity by the sizes and by
    the collision-corrected estimate from the sketches (less margin), then counts the full sets.

    Two sets of similarity 0.8 share no band once in twenty million times. Null and empty texts, and texts without
    words, have no shingles and link with nothing, not even each other; a text of fewer words than a shingle is one
    shingle. Rows that repeat an id share its class if their texts agree; if not, one of the texts is compared.
    Rows with null id stay alone. An empty table gives an empty result. Other columns are not read. Ids are integers.
    """
    integer_ids(df, id_col)
    with temporary() as keep:
        threshold = percent / 100
        sigs = keep(stash(sketches(df, id_col, text_col, words), "sketches"))
        named = sigs.where("n > 0 and id is not null")
        classes = keep(stash(named.groupBy("h0", "h1").agg(F.min("id").cast("long").alias("cid"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes"))

        rows = classes.select("cid", F.posexplode("bands").alias("at", "band")).select("cid", F.xxhash64("at", "band").alias("key"))
        shared = rows.groupBy("key").agg(F.min("cid").alias("hub"), F.count("*").alias("size")).where("size > 1")
        members = rows.withColumn("k", fresh_key("key")).join(shared.withColumn("k", fresh_key("key")), ["k", "key"]).where("cid <> hub")
        pairs = stash(members.select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct(), "members")

        some = pairs.select("a").union(pairs.select("b")).distinct()
        texts = df.select(F.col(id_col).cast("long").alias("cid"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
        # merged at every size: the ids grow with the table, and a plan that changes with size can't be projected
        texts = stash(texts.join(some.withColumnRenamed("a", "cid").hint("merge"), "cid", "left_semi").dropDuplicates(["cid"]), "texts")

        links = stash(_verified(stash(_plausible(pairs, classes, threshold, margin), "pairs"), texts, words, percent), "links")
        found = stash(connected_components(links), "found")

        parts = found.select(F.col("node").alias("cid"), "component", fresh_key("node").alias("k"))
        owned = pairs.select(F.col("a").alias("cid"), F.col("b").alias("hub"), fresh_key("a").alias("k")).join(parts, ["k", "cid"], "left")
        owned = owned.select("cid", "hub", F.coalesce("component", "cid").alias("component"))
        counts = owned.groupBy("hub", "component").agg(F.count("*").alias("c"))
        open_ = counts.groupBy("hub").agg(F.sum("c").alias("m"), F.max(F.struct("c", "component")).alias("major"), F.count("*").alias("parts")).where("parts > 1")
        blocks = lambda c: F.ceil(c / BLOCK).cast("long")
        open_ = open_.select("hub", F.col("major.component").alias("major"), blocks(F.col("m") - F.col("major.c")).alias("bi"), blocks(F.col("m")).alias("bj"), fresh_key("hub").alias("k"))
        sides = owned.withColumn("k", fresh_key("hub")).join(open_, ["k", "hub"]).drop("k").withColumn("k", fresh_key("cid"))
        sides = sides.join(classes.select("cid", "n", "bands", fresh_key("cid").alias("k")), ["k", "cid"])
        at = lambda n: F.pmod(F.xxhash64(F.lit(23), "cid"), F.col(n))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        kept = ["hub", "cid", "component", "n", "bands"]
        one = sides.where("component <> major").select(*kept, F.lit(True).alias("first"), at("bi").alias("i"), upto("bj").alias("j"))
        other = sides.select(*kept, F.lit(False).alias("first"), upto("bi").alias("i"), at("bj").alias("j"))
        tasks = one.unionByName(other).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
        kind = "hub long, cid long, component long, n long, bands array<long>, first boolean, i long, j long"
        # texts move only for classes that sketches leave open
        likely = tasks.mapInPandas(lambda frames: _likely_across(frames, threshold, margin), kind)
        likely = likely.withColumn("k", fresh_key("cid")).join(texts.withColumn("k", fresh_key("cid")), ["k", "cid"]).drop("k")
        likely = likely.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
        more = stash(likely.mapInPandas(lambda frames: _linked_across(frames, words, percent, margin), "a long, b long"), "links")
        if not more.isEmpty():
            found = stash(connected_components(links.union(more)), "found")

        keep(found)
        groups = classes.withColumn("k", fresh_key("cid")).join(found.select(F.col("node").alias("cid"), "component", fresh_key("node").alias("k")), ["k", "cid"], "left")
        groups = groups.select("h0", "h1", "cid", F.coalesce("component", "cid").alias("component"), fresh_key("h0", "h1").alias("k"))
        out = sigs.withColumn("k", F.when(F.expr("n > 0 and id is not null"), fresh_key("h0", "h1"))).join(groups, ["k", "h0", "h1"], "left")
        component = F.coalesce("component", "id")
        return out.select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.coalesce("cid", "id").alias("class_id")
        )


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)

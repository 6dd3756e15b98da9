"""Mixing sources to target weights: exact block quotas, dealt to shards by a hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import stash, temporary, unused, whole_groups
from wattloom.operators.ranks import placed
from wattloom.sources.io import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: A table of sources is a dimension: it is read by the driver, up to this many rows.
MOST_SOURCES = 1_000_000
#: Up to so many of its rows (about 60 bytes each) go to every task, else it is joined.
BROADCAST_SOURCES = 100_000
#: A plan of up to so many blocks (about 60 bytes each) is broadcast, else joined.
BROADCAST_BLOCKS = 400_000


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = 1.5, most: float = 2.0) -> np.ndarray:
    """Words for each source: share of all sizes by weight; what is above most times a source's size goes to the
    others by weight, until none is above."""
    cap, out, free = most * sizes, np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = min(share * sizes.sum(), cap.sum())
    while free.any():
        part = left * weights / weights[free].sum()
        above = free & (part >= cap)
        if not above.any():
            out[free] = part[free]
            break
        out[above] = cap[above]
        left -= cap[above].sum()
        free &= ~above
    return out


#: A part of the quotas: shards lo to hi (not included) get left blocks of the sources nth, all above 0.
Part = tuple[int, int, np.ndarray, np.ndarray]


def splitting_tree(lo: int, hi: int, nth: np.ndarray, left: np.ndarray, seed: int, least: int = 1) -> Iterator[Part]:
    """Parts of at most least shards. Half of the shards get their share of all blocks, drawn without replacement from
    the sources' quotas (multivariate hypergeometric), and so on down; sources of which nothing is left are left out."""
    some = left > 0
    nth, left = nth[some], left[some]
    if hi - lo <= least:
        yield lo, hi, nth, left
        return
    mid = (lo + hi) // 2
    half = int(left.sum()) * (mid - lo) // (hi - lo)
    first = np.random.default_rng((seed, lo, hi)).multivariate_hypergeometric(left, half, method="marginals")
    yield from splitting_tree(lo, mid, nth, first, seed, least)
    yield from splitting_tree(mid, hi, nth, left - first, seed, least)


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """nth, shard, units: blocks of each source in each shard, where there are any. quotas: nth, units.

    One task splits down to at most 256 branches, holding one row a source (there are at most MOST_SOURCES) for each
    level; tasks of their own split the branches.
    """
    least = -(-shards // 256)

    def frame(parts: Iterator[Part]) -> Iterator[pd.DataFrame]:
        for lo, hi, nth, left in parts:
            for i in range(0, len(nth), 1 << 16):
                yield pd.DataFrame({"lo": lo, "hi": hi, "nth": nth[i : i + (1 << 16)], "units": left[i : i + (1 << 16)]})

    def branches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat([pd.DataFrame({"nth": [], "units": []}, dtype="int64"), *frames]).sort_values("nth")
        yield from frame(splitting_tree(0, shards, own["nth"].to_numpy(), own["units"].to_numpy(), seed, least))

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in whole_groups(frames, ["lo", "hi"]):
            yield from frame(splitting_tree(int(g["lo"].iloc[0]), int(g["hi"].iloc[0]), g["nth"].to_numpy(), g["units"].to_numpy(), seed))

    kind = "lo long, hi long, nth long, units long"
    top = quotas.select("nth", "units").repartition(1).mapInPandas(branches, kind)
    split = top.repartition("lo").sortWithinPartitions("lo", "nth").mapInPandas(leaves, kind)
    return split.select("nth", F.col("lo").alias("shard"), "units")


def _plan(sized: DataFrame, weights: tuple, share: float, most: float, shard_words: int, seed: int) -> tuple[DataFrame, int, int]:
    """(plan, blocks, rows of the plan at most): for each (source, block) the shards that take it, with the source's
    size and target."""
    spark = sized.sparkSession
    total = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).toPandas()
    if len(total) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    total = total.iloc[sorted(range(len(total)), key=lambda i: (total["source"][i] is None, (total["source"][i] or "").encode()))].reset_index(drop=True)
    size = total["size"].to_numpy(np.float64)
    goal = targets(size, np.resize(np.array(weights, np.float64), len(total)), share, most)
    base = np.floor(goal / np.maximum(size, 1))
    shards = max(1, int(goal.sum() // shard_words))
    blocks = 1 << max(10, (2 * shards - 1).bit_length())
    rest = goal - base * size
    columns = {"source": total["source"].astype(object), "source_size": total["size"].astype("int64"), "target": goal, "base": base.astype("int64"), "rest": rest, "nth": np.arange(len(total))}
    known = spark.createDataFrame(pd.DataFrame(columns), "source string, source_size long, target double, base long, rest double, nth long")

    weighed = sized.groupBy("source", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(blocks)).alias("block")).agg(F.sum("size").alias("words"))
    # a source's blocks in a seeded order, which spreads over many tasks
    weighed = placed(weighed.withColumn("h", F.xxhash64(F.lit(seed + 1), "source", "block")), ["source"], ["h", "block"], "words").drop("h", "total")
    known = F.broadcast(known) if len(total) <= BROADCAST_SOURCES else known
    picked = weighed.withColumn("before", F.col("below") + F.col("words") / 2).drop("below").join(known, weighed["source"].eqNullSafe(known["source"])).drop(known["source"])
    picked = stash(picked.withColumn("copies", F.col("base") + (F.col("before") < F.col("rest")).cast("long")), "blocks")

    ranges = shard_quotas(picked.groupBy("nth").agg(F.sum("copies").alias("units")), shards, seed)
    ranges = placed(ranges, ["nth"], ["shard"], "units")
    drawn = ranges.select("nth", "shard", F.explode(F.sequence(F.col("below"), F.col("below") + F.col("units") - 1)).alias("at"))

    units = picked.where("copies > 0").select("nth", "block", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    units = units.withColumns({"h": F.xxhash64(F.lit(seed + 2), "nth", "block", "copy"), "one": F.lit(1).cast("long")})
    shuffled = placed(units, ["nth"], ["h", "block", "copy"], "one").select("nth", "block", F.col("below").alias("at"))
    dealt = shuffled.join(drawn, ["nth", "at"])
    dealt = dealt.groupBy("nth", "block").agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    plan = picked.join(dealt, ["nth", "block"], "left").select("source", "block", "source_size", "target", F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"))
    return stash(plan, "plan"), blocks, len(total) * blocks


def _planned(df: DataFrame, plan: DataFrame, blocks: int, rows: int, seed: int, source_col: str, id_col: str, names: list[str]) -> DataFrame:
    """df with what the plan has for it: source, block, source_size, target and shards, under the names given."""
    plan = plan.select(*(F.col(c).alias(n) for c, n in zip(("source", "block", "source_size", "target", "shards"), names, strict=True)))
    block = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(blocks))
    plan = F.broadcast(plan) if rows <= BROADCAST_BLOCKS else plan
    return df.join(plan, (block == F.col(names[1])) & F.col(source_col).eqNullSafe(F.col(names[0])), "left")


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return stash(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "sizes")


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, shard_words: int = 1 << 18, seed: int = 7
) -> DataFrame:
    """One row for each row of df: id, size, source_size, target, taken, shards.

    Sources in code point order, null last, weigh as in weights, repeating; see targets(). The rows of a source are
    dealt by a hash of their id to blocks. Of each source all blocks are taken as often as its target allows whole
    times, and the first blocks of a seeded permutation once more, up to the block border nearest the target. The
    blocks' quotas are split among the output shards by splitting_tree(), and each shard draws its disjoint blocks
    from a permutation. shards lists the shards that take the row; taken is its size once for each of them.

    Size is the number of words; null and empty texts have 0 and may still be dealt. Rows that repeat an id fall
    in one block and are each taken. A source with words in few rows is met only to half a row. An empty table
    gives an empty result. Other columns are not read. Reruns give the same.
    """
    with temporary() as keep, scratch():
        sized = keep(_sized(df, id_col, text_col, source_col))
        plan, blocks, rows = _plan(sized, weights, share, most, shard_words, seed)
        out = _planned(sized, keep(plan), blocks, rows, seed, "source", "id", ["_source", "_block", "source_size", "target", "shards"])
        return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.size("shards") * F.col("size")).alias("taken"), "shards")


def mixed_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, shard_words: int = 1 << 18, seed: int = 7
) -> DataFrame:
    """The rows of df as often as mix() takes them, with the columns of df, whatever their names; a partition holds whole
    shards, each in a seeded random order."""
    *names, copy, shard = unused(df, "source", "block", "source_size", "target", "shards", "copy", "shard")
    with temporary() as keep, scratch():
        plan, blocks, rows = _plan(_sized(df, id_col, text_col, source_col), weights, share, most, shard_words, seed)
        out = _planned(df, keep(plan), blocks, rows, seed, source_col, id_col, names).select(*(df[c] for c in df.columns), F.posexplode(names[4]).alias(copy, shard))
        return out.repartition(shard).sortWithinPartitions(shard, F.xxhash64(F.lit(seed + 3), F.col(id_col), copy)).drop(copy, shard)


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))

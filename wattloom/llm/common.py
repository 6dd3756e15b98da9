"""Helpers that the text operators share: scratch tables, components, sorted group streams, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: White space of the word pattern [^\x20\x09-\x0D]+, which is also what bytes.split() splits at.
SPACE = r"[\x20\x09-\x0D]"

_own_folder: list[str] = []
_open: list[list[DataFrame]] = []


def scratch_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: what spark.checkpoint.dir names, which all executors share.

    Where it is unset, a local session gets a temporary folder; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_folder[0]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a cut of the lineage that survives lost executors.

    The shuffle files of the writing query are of no more use, so Spark is asked to delete them at its end.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/wattloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    if _open:
        _open[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stash() wrote, which nothing reads any more."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(t.stash_path)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, the tables stashed inside it, but for those given to the function that it yields, which a
    result still reads; these go at the end of the next outer block."""
    kept: list[DataFrame] = []
    _open.append([])

    def keep(t: DataFrame) -> DataFrame:
        kept.append(t)
        return t

    try:
        yield keep
    finally:
        paths = {t.stash_path for t in kept}
        discard(*(t for t in _open.pop() if t.stash_path not in paths))
        if _open:
            _open[-1].extend(kept)


def release_memory() -> None:
    """Gives back the memory that a Python worker has freed: workers serve one stage after the other, and what the arrays
    of one leave behind would count beside those of the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim:
        trim(0)


def releasing(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f, which a task maps its batches with; at its end the worker gives back what it has freed."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        release_memory()

    return run


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has as columns, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def integer_ids(df: DataFrame, id_col: str) -> None:
    """Refuses ids that are no integers: components and orders go by the smallest id."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}; ids must be integers")


def fresh_key(*cols: str) -> Column:
    """A derived join key beside the real ones.

    A grouped table is already partitioned by its key, and a join would use that without a new exchange; only
    joins whose two sides are fresh exchanges are split by adaptive execution when a key is hot. The columns must have
    the same types on both sides, as equal numbers of different types hash differently.
    """
    return F.xxhash64(F.lit(17), *cols)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node, component (the smallest node reachable) of every node with a link, by alternating large
    and small stars; each round is a written table, and only its count and checksum reach the driver."""

    def summed(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def starred(e: DataFrame, every: bool) -> DataFrame:
        """every: a node's larger neighbours get its least one (large star), else its smaller ones (small star)."""
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if every else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).withColumn("k", fresh_key("u"))
        out = both.withColumn("k", fresh_key("u")).join(least, ["k", "u"])
        moved = out.where("v > u" if every else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not every:
            moved = moved.union(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = stash(e, "edges")
    was = summed(e)
    while was[0]:
        old, e = e, stash(starred(starred(e, True), False), "edges")
        discard(old)
        now = summed(e)
        if now == was:
            break
        was = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def grouped_frames(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """From the sorted batches of a task, frames that hold whole keys, with the places where their groups begin and the
    end."""
    held: list[pd.DataFrame] = []  # of the last key
    for frame in frames:
        if frame.empty:
            continue
        k = frame[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        new = bool(held) and bool((held[-1][keys].iloc[-1].to_numpy() != k[0]).any())
        if len(cuts) or new:
            last = cuts[-1] if len(cuts) else 0
            whole = pd.concat([*held, frame.iloc[:last]], ignore_index=True)
            before = sum(map(len, held))
            yield whole, np.unique(np.concatenate([[0], [before] if new else [], before + cuts, [len(whole)]]).astype(np.int64))
            held, frame = [], frame.iloc[last:]
        held.append(frame)
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, np.array([0, len(whole)])


def sliced(frames: Iterable[pd.DataFrame], *columns: str, chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Batches cut so that the texts of columns have about so many characters at most, or one row."""
    for f in frames:
        size = sum(f[c].str.len().fillna(0) for c in columns).to_numpy(np.float64).cumsum() if len(f) else np.empty(0)
        lo = 0
        while lo < len(f):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + chars, side="right")))
            yield f.iloc[lo:hi]
            lo = hi


def whole_groups(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """From the sorted batches of a task, the rows of one key after the other."""
    for frame, cuts in grouped_frames(frames, keys):
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield frame.iloc[i:j]


def intersections(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the first split sets with the others, by products of incidence matrices."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    all_, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    out = np.zeros((split, len(sets) - split), np.int64)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for lo in range(0, len(all_), 1 << 16):
        i, j = np.searchsorted(at, [lo, lo + (1 << 16)])
        m = np.zeros((len(sets), min(1 << 16, len(all_) - lo)), np.float32)
        m[row[i:j], at[i:j] - lo] = 1
        out += (m[:split] @ m[split:].T).astype(np.int64)
    return out


def words(text: str) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ with A-Z in lower case; other letters stay."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(text: str | None) -> np.ndarray:
    w = words(text) if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashes of the n-word shingles, ascending; fewer words make one shingle, none make none."""
    if not len(h):
        return h
    n = min(n, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(x)


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit digest of an ascending set."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)

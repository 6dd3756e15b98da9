"""Whitening of embeddings: covariance by distributed sums, leading components by bisection, projection in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import stash, temporary

_EPS = np.finfo(np.float64).eps
_LONG = 2**62


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, next to it, unit vectors of the Householder reflections) of a symmetric matrix."""
    a, p, turns = a.copy(), len(a), []
    for k in range(p - 2):
        v = a[k + 1 :, k].copy()
        alpha = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= alpha
        r = np.linalg.norm(v)
        if r > 0:
            v /= r
            below = a[k + 1 :, k + 1 :]
            w = below @ v
            w -= (v @ w) * v
            below -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = alpha
        turns.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def counts_below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each x the number of eigenvalues below it: sign changes of the Sturm sequence."""
    tiny = _EPS * (np.abs(d).max() + np.abs(e).max(initial=0)) * _EPS + np.finfo(np.float64).tiny
    q = d[0] - x
    out = (q < 0).astype(int)
    for i in range(1, len(d)):
        q = d[i] - x - e[i - 1] ** 2 / np.where(np.abs(q) < tiny, -tiny, q)
        out += q < 0
    return out


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, bisected until no double lies between the ends."""
    around = np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
    at = len(d) - 1 - np.arange(k)
    lo, hi = np.full(k, (d - around).min() - 1e-9), np.full(k, (d + around).max() + 1e-9)
    while True:
        mid = (lo + hi) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            return mid
        above = counts_below(d, e, mid) > at
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)


def _solved(d: np.ndarray, e: np.ndarray, x: float, b: np.ndarray) -> np.ndarray:
    """z of (T - x) z = b by elimination with row exchanges; zero pivots are replaced by tiny ones."""
    n, b = len(d), b.copy()
    tiny = _EPS * max(np.abs(d).max(), np.abs(e).max(initial=0), np.finfo(np.float64).tiny / _EPS)
    u0, u1, u2 = d - x, np.append(e, 0.0), np.zeros(n)
    for i in range(n - 1):
        low = e[i]
        if abs(low) > abs(u0[i]):
            u0[i], u1[i], u2[i], below, after = low, u0[i + 1], u1[i + 1], u0[i], u1[i]
            m = below / low
            u0[i + 1], u1[i + 1] = after - m * u1[i], -m * u2[i]
            b[i], b[i + 1] = b[i + 1], b[i] - m * b[i + 1]
        else:
            u0[i] = u0[i] or tiny
            m = low / u0[i]
            u0[i + 1] -= m * u1[i]
            b[i + 1] -= m * b[i]
    for i in range(n - 1, -1, -1):
        rest = (u1[i] * b[i + 1] if i + 1 < n else 0.0) + (u2[i] * b[i + 2] if i + 2 < n else 0.0)
        b[i] = (b[i] - rest) / (u0[i] if abs(u0[i]) > tiny else tiny)
    return b


def leading_components(v: np.ndarray, k: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(up to k largest eigenvalues of a covariance, their unit vectors as columns); values that are zero but for
    rounding are left out. Vectors of values close together are made orthogonal to each other; the largest entry of
    each is positive."""
    size = np.abs(v).max(initial=0.0)
    if not size > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    d, e, turns = tridiagonal(v / size)
    values = leading_values(d, e, min(k, len(v)))
    values = values[values > 16 * len(v) * _EPS * values[0]]
    near = 1e-3 * max(np.abs(d).max(), np.abs(e).max(initial=0))
    rng, found = np.random.default_rng(7), []
    for i, x in enumerate(values):
        group = [z for z, y in zip(found, values) if y - x < near]
        z = rng.standard_normal(len(d))
        for _ in range(4):
            for _ in range(2):
                for y in group:
                    z -= (y @ z) * y
            z = _solved(d, e, x + (i % 8) * _EPS * abs(values[0]), z / np.linalg.norm(z))
            z /= np.abs(z).max()
        for _ in range(2):
            for y in group:
                z -= (y @ z) * y
        found.append(z / np.linalg.norm(z))
    out = np.column_stack(found)
    for j in range(len(turns) - 1, -1, -1):
        out[j + 1 :] -= 2 * np.outer(turns[j], turns[j] @ out[j + 1 :])
    out /= np.linalg.norm(out, axis=0)
    return values * size, out * np.where(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])] < 0, -1.0, 1.0)


def whole_vectors(col: pa.ListArray, p: int, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose vector has p finite entries, floor(scale * entry) + shift of these as long)."""
    length = np.diff(col.offsets.to_numpy())
    rows = np.flatnonzero((length == p) & ~np.asarray(col.is_null()))
    entries = col.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls come as NaN
    x = entries[col.offsets.to_numpy()[rows][:, None] + np.arange(p)]
    ok = np.isfinite(x).all(axis=1)
    return rows[ok], np.clip(np.floor(scale * x[ok]), -_LONG, _LONG).astype(np.int64) + shift


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """Of each vector and leading component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries become longs, x = floor(scale * entry) + shift. Two passes over all vectors sum x and the products of the
    centred x; each task adds up its own, Spark adds those, and one p x p matrix (p: length of the vectors) reaches the
    driver. It is made tridiagonal by Householder reflections; its leading eigenvalues come by bisection over Sturm
    counts and their vectors by inverse iteration. The mean and the components, p numbers each, go to all tasks, which
    project. Two more passes over the projections measure their covariance: identity_error is its largest distance from
    the identity. deviation is the squared distance of n x from the sums, exact, null where no long holds it.

    Rows are dropped whose vector is null or holds entries that are null, NaN or infinite; of vectors of several lengths
    only those of the most frequent (the largest of equally frequent ones) count, so empty vectors go with them.
    Components without variance are left out, so equal vectors, a single one and an empty table give no rows. Entries
    beyond 2^62 / scale count as that. Null ids stay, and rows that repeat an id are projected one by one. Other columns
    are not read.
    """
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    lengths = rows.where("size(v) > 0").groupBy(F.size("v").alias("p")).count().orderBy(F.desc("count"), F.desc("p")).first()
    p = lengths.p if lengths else 0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * p
        for b in batches:
            _, x = whole_vectors(b.column("v"), p, scale, shift)
            if x.size:
                x = x if float(np.abs(x).max()) * len(x) < _LONG else x.astype(object)
                n, total = n + len(x), [a + int(s) for a, s in zip(total, x.sum(axis=0))]
        yield pa.record_batch({"at": pa.array(range(p + 1), pa.int32()), "s": pa.array([str(n), *map(str, total)])})

    parts = rows.select("v").mapInArrow(sums, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total = {r.at: int(r.s or Decimal(0)) for r in parts.collect()}
    n, s = total.get(0, 0), [total.get(i + 1, 0) for i in range(p)]
    mean = np.array([a / n for a in s]) if n else np.zeros(p)
    most = max(map(abs, s), default=0)

    def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n x - S as longs, or as Python's integers where squares could be larger, x - S / n)."""
        far = n * int(np.abs(x).max(initial=0)) + most
        d = n * (x if far < _LONG else x.astype(object)) - np.array(s, np.int64 if far < _LONG else object)
        return d if p * far * far < _LONG else d.astype(object), (d / n).astype(np.float64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((p, p))
        for b in batches:
            _, x = whole_vectors(b.column("v"), p, scale, shift)
            for lo in range(0, len(x), 4096):
                c = centred(x[lo : lo + 4096])[1]
                g += c.T @ c
        at = np.triu_indices(p)
        yield pa.record_batch({"i": pa.array(at[0].astype(np.int32)), "j": pa.array(at[1].astype(np.int32)), "s": pa.array(g[at])})

    v = np.zeros((p, p))
    if n:
        for r in rows.select("v").mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
            v[r.i, r.j] = v[r.j, r.i] = r.s / n
    values, vectors = leading_components(v, components)
    m, trace = len(values), float(np.trace(v))
    turn = vectors / np.sqrt(values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = whole_vectors(b.column("v"), p, scale, shift)
            for lo in range(0, len(x), 4096):
                d, c = centred(x[lo : lo + 4096])
                far = [int(y) if y < 2**63 else None for y in (d * d).sum(axis=1)]
                y = pa.FixedSizeListArray.from_arrays(pa.array((c @ turn).ravel()), m).cast(pa.list_(pa.float64()))
                yield pa.record_batch({"id": b.column("id").take(pa.array(at[lo : lo + 4096])), "deviation": pa.array(far, pa.int64()), "w": y})

    if not m:
        names = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.where("false").select(F.col("id").alias(id_col), *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in names.split(", ")))
    with temporary() as keep:
        # the result reads it; a pipeline deletes it when it has written the stage
        w = keep(stash(rows.mapInArrow(projected, f"id {kind.simpleString()}, deviation long, w array<double>"), "whitened"))
        middle = w.agg(*(F.avg(F.col("w")[i]) for i in range(m))).first()
        c = [F.col("w")[i] - middle[i] for i in range(m)]
        pairs = [(i, j) for i in range(m) for j in range(i, m)]
        cov = w.agg(*(F.avg(c[i] * c[j]) for i, j in pairs)).first()
    error = max(abs(x - (i == j)) for x, (i, j) in zip(cov, pairs, strict=True))
    share = F.array(*(F.lit(float(x / trace)) for x in values))
    long = w.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error")
    )


def op11_whiten_embeddings(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

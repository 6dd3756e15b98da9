"""Whitening against NumPy, with odd vectors and tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm.whitening import leading_components, op11_whiten_embeddings, whitened

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in enumerate(vectors)], SCHEMA).repartition(3)


@pytest.mark.parametrize("p", [1, 2, 3, 5, 20, 64])
def test_components_are_those_of_numpy(p):
    rng = np.random.default_rng(p)
    a = rng.standard_normal((3 * p, p)) * np.geomspace(1, 1e-2, p)
    v = a.T @ a
    values, vectors = leading_components(v, 8)
    want = np.linalg.eigvalsh(v)[::-1][:8]
    assert values == pytest.approx(want, rel=1e-11)
    assert vectors.T @ vectors == pytest.approx(np.eye(len(values)), abs=1e-12)
    assert v @ vectors == pytest.approx(vectors * values, abs=1e-12 * want[0])


@pytest.mark.parametrize("values", [[5, 5, 5, 2, 2, 1], [1.0] * 9, [3, 3 - 1e-13, 3 - 2e-13, 1, 0, 0], [4, 0, 0], [1e300, 1e299], [1e-300, 1e-301]], ids=str)
def test_equal_and_missing_values(values):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values),) * 2))[0]
    v = (q * values) @ q.T
    got, vectors = leading_components((v + v.T) / 2, 8)
    full = [x for x in sorted(values, reverse=True)[:8] if x > 0]
    assert got == pytest.approx(full, rel=1e-9) and vectors.T @ vectors == pytest.approx(np.eye(len(full)), abs=1e-11)
    assert v @ vectors / full[0] == pytest.approx(vectors * got / full[0], abs=1e-11)


def test_diagonal_and_empty():
    values, vectors = leading_components(np.diag([1.0, 7.0, 3.0]), 2)
    assert values.tolist() == pytest.approx([7, 3]) and np.abs(vectors).round(9).tolist() == [[0, 0], [1, 0], [0, 1]]
    assert leading_components(np.zeros((4, 4)))[0].size == 0 and leading_components(np.zeros((0, 0)))[0].size == 0


def wanted(vectors):
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(float)).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, q = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - s) ** 2).sum(axis=1), c @ q[:, ::-1][:, :8] / np.sqrt(values[::-1][:8]), values[::-1][:8] / values.sum()


def compared(rows, vectors, ids):
    n, far, w, share = wanted(vectors)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == len(ids) * w.shape[1]
    for k in range(w.shape[1]):
        own = np.array([got[i, k + 1].whitened for i in ids])
        assert own * np.sign(own @ w[:, k]) == pytest.approx(w[:, k], abs=1e-8)
    assert all(r.n == n and r.deviation == far[ids.index(r.vec_id)] and r.explained == pytest.approx(share[r.component - 1]) and 0 <= r.identity_error < 1e-9 for r in rows)


def test_whitened_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) * 0.1
    vectors[50:60] = vectors[0]  # copies
    odd = [None, [], [1.0], [float("nan")] + [0.0] * 11, [float("inf")] + [0.0] * 11, [None] + [0.0] * 11, [0.5] * 13]
    df = table(spark, [*vectors, *odd]).withColumns({c: F.lit("x") for c in ("id", "v", "at", "w", "n", "component", "deviation", "whitened")})
    compared(whitened(df).collect(), vectors, list(range(300)))


def test_query_on_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    good = [r for r in rows if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]
    compared(op11_whiten_embeddings(spark, "/root/testdata/sf0.01").collect(), [r.embedding for r in good], [r.vec_id for r in good])


def test_odd_tables(spark):
    for vectors in ([], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        got = whitened(table(spark, vectors))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0
    # a null id, one that repeats, fewer dimensions than components
    got = whitened(table(spark, [[0.0, 1.0], [1.0, 0.0], [1.0, 3.0]], [None, 4, 4])).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == [("4", 1), ("4", 1), ("4", 2), ("4", 2), ("None", 1), ("None", 2)]
    # entries whose squares no long holds
    got = whitened(table(spark, [[0.0, 1e30], [1.0, -1e30], [0.0, 1e30]])).collect()
    assert all(r.deviation is None and np.isfinite(r.whitened) for r in got)

"""Links that a window of sorted vectors keeps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from test_dedup import roots
from wattloom.llm import embedding_dedup
from wattloom.llm.embedding_dedup import _least_passes, _linked_in_windows, embedding_duplicates


def links(frames):
    out = pd.concat(frames)
    return out[out["task"].isna()].astype({"a": int, "b": int})


def test_leaves_before_their_hub_stay_linked():
    leaves = np.eye(11)[1:] * np.sqrt(1 - 0.94**2) + np.eye(11)[0] * 0.94  # 0.94 from the hub, 0.88 from each other
    v = [*leaves, np.eye(11)[0]]
    f = pd.DataFrame({"pass": 0, "part": 1, "cid": range(11), "window": 16, "v": v})
    out = links(_linked_in_windows(iter([f]), 0.93))
    assert {tuple(sorted(x)) for x in out[["a", "b"]].to_numpy().tolist()} == {(i, 10) for i in range(10)}


def test_connections_of_all_links():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((300, 3))
    f = pd.DataFrame({"pass": 0, "part": 1, "cid": range(300), "window": 40, "v": list(v)})
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.argwhere(np.tril(u @ u.T >= 0.99, -1))
    for frames in ([f], [f[:7], f[7:8], f[8:190], f[190:]]):
        out = links(_linked_in_windows(iter(frames), 0.99))
        assert roots(300, out[["a", "b"]].to_numpy()) == roots(300, [x for x in near if x[0] - x[1] <= 40])


def tight(n, mean, pairs, seed, dims=64):
    """n unit vectors of cosine mean to each other on average, the first of which have partners at a cosine of 0.94."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = unit(rng.standard_normal((1, dims)))
    d = rng.standard_normal((n - pairs, dims))
    v = unit(np.sqrt(mean) * centre + np.sqrt(1 - mean) * unit(d - (d @ centre.T) * centre))
    e = rng.standard_normal((pairs, dims))
    e = unit(e - (e * v[:pairs]).sum(axis=1, keepdims=True) * v[:pairs])
    return np.concatenate([v, 0.94 * v[:pairs] + np.sqrt(1 - 0.94**2) * e])


def force(v, threshold=0.93):
    found = []
    for lo in range(0, len(v), 2000):
        i, j = np.nonzero(v[lo : lo + 2000] @ v.T >= threshold)
        found.append(np.stack([i + lo, j])[:, i + lo > j])
    return np.concatenate(found, axis=1).T


@pytest.mark.parametrize("mean", [0.0, 0.7, 0.85])
def test_recall_in_tight_clusters(spark, mean):
    v = tight(6_000, mean, 300, 3)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(v)), "embedding": v.tolist(), "label": 1}), "vec_id long, embedding array<double>, label int")
    want = force(v)
    assert len(want) >= 300
    n = np.bincount(want.ravel(), minlength=len(v))
    got = embedding_duplicates(df.repartition(6)).toPandas().sort_values("vec_id")
    assert (got["n_links"].to_numpy() != n).mean() <= 0.001
    assert (got["component_id"].to_numpy() != np.array(roots(len(v), want))).mean() <= 0.001


def test_windows_go_over_borders(spark, monkeypatch):
    """Tasks of few rows find the links of one that has all."""
    v = tight(4000, 0.0, 300, 4)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(v)), "embedding": v.tolist(), "label": 1}), "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, n, *cols, f=DataFrame.repartitionByRange: f(self, 40, *cols))
    got = embedding_duplicates(df, windows=(128,)).toPandas().sort_values("vec_id")
    assert (got["n_links"].to_numpy() != np.bincount(force(v).ravel(), minlength=len(v))).sum() <= 2


def labelled(spark, *groups):
    rows = [(x.tolist(), label) for label, v in enumerate(groups) for x in v]
    df = pd.DataFrame({"vec_id": range(len(rows)), "embedding": [r[0] for r in rows], "label": [r[1] for r in rows]})
    return spark.createDataFrame(df, "vec_id long, embedding array<double>, label int")


def test_labels_beyond_the_passes_meet_in_blocks(spark):
    """Without passes every label takes the exact way, also one of several blocks: links and components are all there."""
    v, w = tight(4500, 0.85, 300, 6), tight(50, 0.0, 10, 7)
    want = np.concatenate([force(v), force(w) + len(v)])
    n = len(v) + len(w)
    got = embedding_duplicates(labelled(spark, v, w), most_passes=0).toPandas().sort_values("vec_id")
    assert got["n_links"].tolist() == np.bincount(want.ravel(), minlength=n).tolist()
    assert got["component_id"].tolist() == roots(n, want)


def test_passes_in_turn(spark, monkeypatch):
    """Few passes at once find what all at once do."""
    df = labelled(spark, tight(1000, 0.5, 80, 8))
    want = sorted(map(str, embedding_duplicates(df, windows=(128,)).collect()))
    monkeypatch.setattr(embedding_dedup, "AT_ONCE", 2)
    assert sorted(map(str, embedding_duplicates(df, windows=(128,)).collect())) == want


def test_least_passes():
    near, c = np.array([0.01, 0.2]), np.array([30, 70])
    p = _least_passes(near, c, 1e-6, 10**6)
    missed = [(c * (1 - near) ** x).sum() / c.sum() for x in (p - 1, p)]
    assert missed[1] <= 1e-6 < missed[0]
    assert _least_passes(near, c, 1e-6, p - 1) is None and _least_passes(np.zeros(1), np.ones(1), 1e-6, 10**9) is None

"""Exact quantiles, ranks and the global models against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom.operators import diagnostics as D
from wattloom.operators import mef as M
from wattloom.operators import ranks
from wattloom.operators.ranks import average_rank, average_ranks, exact_quantiles
from wattloom.sources import io


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 9, list(np.random.default_rng(0).integers(0, 40, 3000).astype(float)), list(np.random.default_rng(1).standard_normal(5000))], ids=len)
def test_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(5)
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    assert exact_quantiles(df, "x", probs) == pytest.approx(np.quantile(values, probs).tolist())
    assert exact_quantiles(df, "x", probs, midpoint=True) == pytest.approx(np.quantile(values, probs, method="midpoint").tolist())
    got = average_rank(df.where("x is not null"), "x", "r").toPandas().sort_values("x")
    assert got["r"].tolist() == pd.Series(sorted(values)).rank().tolist()


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, "x", [0.5, 1.0]) == [None, None] and exact_quantiles(df.where("false"), "x", [0.5]) == [None]


def series(spark, n=2000, seed=4):
    rng = np.random.default_rng(seed)
    q, x = rng.uniform(1, 50, n), rng.standard_normal(n)
    y = 100 + 12 * q - 0.08 * q**2 + 5 * x + rng.standard_normal(n) * 3
    y[: n // 50] += 400  # outliers
    f = pd.DataFrame({"q": q, "x": x, "y": y})
    return f, spark.createDataFrame(f).repartition(4)


def test_eigenvalues_of_the_gram_matrix(spark):
    f, df = series(spark)
    a = f[["q", "x", "y"]].to_numpy()
    want = np.linalg.eigvalsh(a.T @ a)[::-1]
    rows = sorted(D.eigen_condition(df, ["q", "x", "y"]).collect())
    assert [r.eigenvalue for r in rows] == pytest.approx(want.tolist())
    assert rows[0].condition == pytest.approx(float(np.sqrt(want[0] / want[-1])))


def test_search_fits_each_group(spark):
    f, df = series(spark)
    row = M.search_models(df, "y", "q", [{"q": 3}], [["x"]]).first()
    bins = np.digitize(f["q"], np.quantile(f["q"], [1 / 3, 2 / 3], method="midpoint"), right=True)
    scores = []
    for b in range(3):
        g = f[bins == b]
        a = np.column_stack([np.ones(len(g)), g["q"], g["q"] ** 2, g["x"]])
        e = g["y"] - a @ np.linalg.lstsq(a, g["y"], rcond=None)[0]
        scores.append((len(g), 1 - (e**2).sum() / ((g["y"] - g["y"].mean()) ** 2).sum(), np.sqrt((e**2).mean())))
    n, r2, rmse = map(np.array, zip(*scores, strict=True))
    assert (row.n_groups, row.n_obs) == (3, len(f))
    assert row.r2_macro == pytest.approx(r2.mean(), abs=1e-6) and row.rmse_micro == pytest.approx((rmse * n).sum() / n.sum(), rel=1e-6)


def huber_by_force(x, y, epsilon, alpha):
    """Weights and scale by turns of reweighted fits and scales, until nothing moves."""
    w = np.linalg.lstsq(x, y, rcond=None)[0]
    scale = np.sqrt(np.mean((y - x @ w) ** 2))
    pen = alpha * np.diag(np.append(0.0, np.ones(x.shape[1] - 1)))
    for _ in range(100_000):
        r = y - x @ w
        near = np.abs(r) <= epsilon * scale
        v = np.where(near, 1.0, epsilon * scale / np.maximum(np.abs(r), 1e-300))
        new = np.linalg.solve(x.T @ (x * v[:, None]) + pen * scale, x.T @ (v * y))
        r = y - x @ new
        near = np.abs(r) <= epsilon * scale
        was, scale = scale, np.sqrt((r[near] ** 2).sum() / (len(y) - epsilon**2 * (~near).sum()))
        if np.abs(new - w).max() < 1e-13 * np.abs(w).max() and abs(scale - was) < 1e-13 * scale:
            break
        w = new
    return w, scale


@pytest.mark.parametrize(("epsilon", "alpha"), [(1.35, 1e-4), (1.05, 5.0), (3.0, 0.0)])
def test_huber_is_the_joint_minimum(spark, epsilon, alpha):
    f, df = series(spark)
    model = M.poly_huber(df, "q", "y", 2, ["x"], epsilon=epsilon, alpha=alpha, standard=True)
    z = (f["q"] - f["q"].mean()) / f["q"].std(ddof=0)
    d = (f["x"] - f["x"].mean()) / f["x"].std(ddof=0)
    x = np.column_stack([np.ones(len(f)), z, z**2, z * d, d])
    w, scale = huber_by_force(x, f["y"].to_numpy(), epsilon, alpha)
    assert list(model.coefficients) == ["const", "z1", "z2", "z*x", "x"]
    assert list(model.coefficients.values()) == pytest.approx(w.tolist(), rel=1e-6, abs=1e-6)
    assert M.huber_weights(df, model.columns(), "y", epsilon, alpha)[1] == pytest.approx(scale, rel=1e-6)
    me = df.select("q", "x", model.me().alias("m")).toPandas()
    zz, dd = (me["q"] - f["q"].mean()) / f["q"].std(ddof=0), (me["x"] - f["x"].mean()) / f["x"].std(ddof=0)
    assert np.allclose(me["m"], (w[1] + 2 * w[2] * zz + w[3] * dd) / f["q"].std(ddof=0))


def test_ridge_is_the_closed_form(spark):
    f, df = series(spark)
    df = df.repartition(3)
    model = M.poly_ridge(df, "q", "y", 2, ["x"], alphas=(1e-6, 0.5, 80.0, 1e7), standard=True)
    z, d = ((f[c] - f[c].mean()) / f[c].std(ddof=0) for c in "qx")
    x = np.column_stack([np.ones(len(f)), z, z**2, z * d, d])
    fold = {(r.q, r.y): r.f for r in df.select("q", "y", F.pmod(F.xxhash64(*df.columns), F.lit(5)).alias("f")).collect()}
    fold = np.array([fold[k] for k in zip(f["q"], f["y"])])
    fit = lambda a, x, y: np.linalg.solve(x.T @ x + a * np.diag([0, 1, 1, 1, 1]), x.T @ y)
    y = f["y"].to_numpy()
    for a, score in model.scores.items():
        want = sum(((y[fold == k] - x[fold == k] @ fit(a, x[fold != k], y[fold != k])) ** 2).sum() for k in range(5)) / len(y)
        assert score == pytest.approx(want, rel=1e-8)
    assert model.alpha == min(model.scores, key=model.scores.get) and len(model.scores) == 4
    assert list(model.coefficients.values()) == pytest.approx(fit(model.alpha, x, y).tolist(), rel=1e-8)


def basis(x, lo, hi, n):
    """Cubic B-splines by the recursion over degrees."""
    h = (hi - lo) / (n - 3)
    t = lo + h * np.arange(-3, n + 1)
    b = [((t[i] <= x) & (x < t[i + 1])).astype(float) for i in range(n + 3)]
    b[n - 1][x >= hi], b[n][x >= hi] = 1.0, 0.0  # the last interval is closed
    for k in range(1, 4):
        b = [(x - t[i]) / (k * h) * b[i] + (t[i + k + 1] - x) / (k * h) * b[i + 1] for i in range(len(b) - 1)]
    return np.column_stack(b)


def test_spline_is_the_closed_form(spark):
    f, df = series(spark)
    f = f.assign(v=np.random.default_rng(6).uniform(-2, 3, len(f)))
    df = spark.createDataFrame(f).repartition(4)
    penalties, n = (0.1, 10.0, 1000.0), 8
    model = M.spline_fit(df, "q", "y", ["v"], ["x"], n, penalties)
    parts = [basis(f[c].to_numpy(), f[c].min(), f[c].max(), n) for c in "qv"]
    x = np.column_stack([np.ones(len(f)), *parts, f["x"]])
    second = np.diff(np.eye(n), 2, axis=0)
    pen = np.zeros((x.shape[1],) * 2)
    for k in range(2):
        pen[1 + k * n : 1 + (k + 1) * n, 1 + k * n : 1 + (k + 1) * n] = second.T @ second
    y, gcv = f["y"].to_numpy(), {}
    for p in penalties:
        inverse = np.linalg.pinv(x.T @ x + p * pen, rcond=1e-12)
        gcv[p] = len(y) * ((y - x @ (inverse @ x.T @ y)) ** 2).sum() / (len(y) - np.trace(inverse @ x.T @ x)) ** 2
    assert model.scores == pytest.approx(gcv, rel=1e-6) and model.penalty == min(gcv, key=gcv.get)
    w = np.linalg.pinv(x.T @ x + model.penalty * pen, rcond=1e-12) @ x.T @ y
    got = df.select("q", "v", "x", model.predict().alias("p"), model.me().alias("me")).toPandas()
    at = lambda q: np.column_stack([np.ones(len(got)), basis(q, f["q"].min(), f["q"].max(), n), basis(got["v"].to_numpy(), f["v"].min(), f["v"].max(), n), got["x"]]) @ w
    q = got["q"].to_numpy()
    assert np.allclose(got["p"], at(q), rtol=1e-6)
    inside = (q > f["q"].min() + 0.01) & (q < f["q"].max() - 0.01)
    assert np.allclose(got["me"][inside], ((at(q + 1e-4) - at(q - 1e-4)) / 2e-4)[inside], rtol=1e-4, atol=1e-4)


def test_spline_follows_the_curve(spark):
    f, df = series(spark)
    f = f[40:]
    df = spark.createDataFrame(f)
    model = M.spline_fit(df, "q", "y", linear=["x"], n=8)
    got = df.select("q", "x", model.predict().alias("p"), model.me().alias("me")).toPandas()
    assert np.abs(got["p"] - (100 + 12 * got["q"] - 0.08 * got["q"] ** 2 + 5 * got["x"])).max() < 4
    assert np.abs(got["me"] - (12 - 0.16 * got["q"])).mean() < 0.6


CONFIGS = [
    {"bins": {"q": 3}, "controls": []}, {"bins": {"q": 3}, "controls": ["x"]}, {"bins": {"x": 2, "q": 2}, "controls": ["v"]},
    {"family": "poly", "degree": 1}, {"family": "poly", "degree": 3, "interactions": ["x"], "controls": ["v"], "alpha": 4.0}, {"family": "huber", "degree": 2, "controls": ["v"]},
    {"family": "spline", "n": 6, "penalty": 2.0, "controls": ["x"]}, {"family": "spline", "n": 6, "penalty": 50.0, "smooths": ["v"]}, {"family": "spline", "n": 6, "penalty": 30.0},
]


def test_search_over_families_equals_single_fits(spark):
    f, _ = series(spark)
    rng = np.random.default_rng(9)
    f = f.assign(v=rng.uniform(-2, 3, len(f)), part=rng.choice(["train", "validation"], len(f), p=[0.7, 0.3]))
    df = spark.createDataFrame(f).repartition(4)
    got = {(r.params_json, r.split): r for r in M.search_families(df, "y", "q", CONFIGS, "part").collect()}
    assert len(got) == 2 * len(CONFIGS) and {r.family for r in got.values()} == {"bins", "poly", "huber", "spline"}
    import json

    train = df.where("part = 'train'")
    for c in CONFIGS:
        name = json.dumps(c | {"y": "y", "q": "q"}, sort_keys=True)
        for part in ("train", "validation"):
            r, rows = got[name, part], df.where(F.col("part") == part)
            if "bins" in c:
                edges = M.quantile_bins_fit(train, c["bins"])
                fits = M.groupwise_ols(M.quantile_bins(train.withColumn("q2", F.col("q") * F.col("q")), edges), "y", ["q", "q2", *c["controls"]], ["group_id"])
                k = F.col("coefficients")
                at = M.quantile_bins(rows.withColumn("q2", F.col("q") * F.col("q")), edges).join(fits.select("group_id", "coefficients"), "group_id")
                p = at.withColumn("p", k["const"] + sum((k[x] * F.col(x) for x in ("q", "q2", *c["controls"])), F.lit(0.0)))
            else:
                model = {
                    "poly": lambda: M.poly_ols(train, "q", "y", c["degree"], c.get("interactions", ()), c.get("controls", ()), c.get("alpha", 0.0), True),
                    "huber": lambda: M.poly_huber(train, "q", "y", c["degree"], (), c["controls"]),
                    "spline": lambda: M.spline_fit(train, "q", "y", c.get("smooths", ()), c.get("controls", ()), c["n"], c["penalty"]),
                }[c["family"]]()
                p = rows.withColumns({"p": model.predict(), "group_id": F.lit(0)})
            want = M.macro_micro_means(M.point_metrics(p, "y", "p", ["group_id"]), ["r2", "rmse", "mae"]).first()
            for m in ("r2", "rmse", "mae"):
                assert r[f"{m}_macro"] == pytest.approx(want[f"{m}_macro"], rel=1e-6, abs=1e-8), (c, part, m)
                assert r[f"{m}_micro"] == pytest.approx(want[f"{m}_micro"], rel=1e-6, abs=1e-8), (c, part, m)
            assert r.n_obs == rows.count()
    left = M.search_families(df, "y", "q", CONFIGS[3:5], "part", done=[r.config for r in got.values() if r.params_json != json.dumps(CONFIGS[3] | {"y": "y", "q": "q"}, sort_keys=True)])
    assert {r.family for r in left.collect()} == {"poly"} and left.count() == 2
    with pytest.raises(ValueError):
        M.search_families(df, "y", "q", CONFIGS, "part", done=[r.config for r in got.values()])


def grouped(spark, parts=12):
    """A hot group of many values with ties, small ones, a null group and nulls, dealt over many ranges."""
    rng = np.random.default_rng(8)
    g = np.append(np.full(6000, "hot"), rng.choice(["a", "b", "c", None], 900))
    v = np.where(rng.random(len(g)) < 0.3, 7.0, rng.integers(0, 3000, len(g)) / 4)  # a third has one value
    v[rng.random(len(g)) < 0.02] = np.nan
    f = pd.DataFrame({"i": np.arange(len(g)), "g": g, "v": v})
    rows = [(int(i), x, None if np.isnan(y) else float(y)) for i, x, y in f.itertuples(index=False)]
    return f, spark.createDataFrame(rows, "i long, g string, v double").repartition(parts)


@pytest.fixture
def many_ranges(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_ranks_of_a_hot_group(spark, many_ranges):
    f, df = grouped(spark)
    got = average_ranks(df, {"v": "r"}, ["g"]).toPandas().set_index("i").sort_index()
    want = f.groupby("g", dropna=False)["v"].rank()
    assert np.allclose(got["r"].to_numpy(float), want.to_numpy(float), equal_nan=True)
    levels = df.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    parts = ranks._ordered(levels, ["g"], ["v"], "n").groupBy("g").agg(F.countDistinct("_part").alias("n")).collect()
    assert max(r.n for r in parts if r.g == "hot") >= 7


def test_quantiles_of_groups(spark, many_ranges):
    f, df = grouped(spark)
    df = df.withColumn("w", -F.col("i"))
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {(r.g, r.column): list(r.q) for r in ranks.grouped_quantiles(df, ["v", "w"], probs, ["g"]).collect()}
    assert len(got) == 10
    for (g, c), q in got.items():
        own = f[f["g"].isna()] if g is None else f[f["g"] == g]
        x = own["v"].dropna() if c == "v" else -own["i"]
        assert q == pytest.approx(np.quantile(x, probs).tolist())
    middle = {(r.g, r.column): list(r.q) for r in ranks.grouped_quantiles(df, ["v"], probs, ["g"], midpoint=True).collect()}
    hot = f[f["g"] == "hot"]["v"].dropna()
    assert middle["hot", "v"] == pytest.approx(np.quantile(hot, probs, method="midpoint").tolist())
    several = exact_quantiles(df, ["w", "v"], probs)
    assert several["v"] == pytest.approx(np.quantile(f["v"].dropna(), probs).tolist()) and several["w"][0] == -len(f) + 1


def test_places_and_running_sums(spark, many_ranges):
    f, df = grouped(spark)
    got = ranks.running_sum(df, ["g"], ["i"], "v", "s").toPandas().sort_values("i")
    want = f.assign(v=f["v"].fillna(0)).groupby("g", dropna=False)["v"].cumsum()
    assert np.allclose(got["s"], want)
    one = ranks.placed(df.withColumn("n", F.lit(1).cast("long")), ["g"], [F.desc_nulls_last("v"), "i"], "n").toPandas()
    order = f.sort_values(["v", "i"], ascending=[False, True]).groupby("g", dropna=False).cumcount()
    assert one.set_index("i")["below"].sort_index().tolist() == order.sort_index().tolist()
    sizes = f["g"].value_counts(dropna=False)
    assert all(t == sizes[g] for g, t in zip(one["g"], one["total"]) if isinstance(g, str))
    empty = df.where("false")
    assert ranks.running_sum(empty, ["g"], ["i"], "v", "s").count() == 0 and ranks.grouped_quantiles(empty, ["v"], probs=[0.5], by=["g"]).count() == 0


def test_scratch_tables_go(spark):
    import os

    with io.scratch() as outer:
        with io.scratch() as keep:
            gone, stays = io.kept(spark.range(3)), keep(io.kept(spark.range(4)))
        files = [t.inputFiles()[0].removeprefix("file://") for t in (stays,)]
        assert stays.count() == 4 and os.path.exists(files[0])
        with pytest.raises(Exception):
            gone.count()
        assert outer
    assert not os.path.exists(files[0])

"""Marginal emission factors: bins, regressions from distributed Gram sums, ramp scores, calibration and confidence."""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.operators.ranks import average_ranks, exact_quantiles, with_quantiles

# --- bins -------------------------------------------------------------------------------------------------------------


def midpoint_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float]:
    """Exact quantiles that take the middle of the two values around a place."""
    return exact_quantiles(df, col, probs, midpoint=True)


def quantile_bins_fit(df: DataFrame, specs: dict[str, int]) -> dict[str, list[float]]:
    """Edges of each column: least - 1e-4, inner midpoint quantiles, largest + 1e-4, without repeats."""
    probs = sorted({0.0, 1.0, *(i / n for n in specs.values() for i in range(1, n))})
    q = {x: dict(zip(probs, v, strict=True)) for x, v in exact_quantiles(df, list(specs), probs, midpoint=True).items()}
    return {x: sorted({q[x][0.0] - 1e-4, *(q[x][i / n] for i in range(1, n)), q[x][1.0] + 1e-4}) for x, n in specs.items()}


def bin_of(col: str | Column, edges: Sequence[float], oob: str = "clip") -> Column:
    """Right-closed bin from 1; out of range: 'clip', 'edge' (0 and last + 1) or 'error'."""
    x = F.col(col) if isinstance(col, str) else col
    inner = edges[1:-1] if oob == "clip" else edges
    b = sum((F.when(x > e, 1).otherwise(0) for e in inner), F.lit(1 if oob == "clip" else 0))
    if oob == "error":
        b = F.when((b < 1) | (b >= len(edges)), F.raise_error(F.lit("value out of range"))).otherwise(b)
    return F.when(x.isNotNull(), b).cast("int")


def quantile_bins(df: DataFrame, edges: dict[str, list[float]], oob: str = "clip", name: str = "group_id") -> DataFrame:
    """<col>_bin of each column and a mixed-radix group id from 1."""
    df = df.withColumns({f"{x}_bin": bin_of(x, e, oob) for x, e in edges.items()})
    gid, radix = F.lit(1), 1
    for x, e in reversed(edges.items()):
        gid = gid + (F.col(f"{x}_bin") - 1) * radix
        radix *= len(e) - 1
    return df.withColumn(name, gid.cast("int"))


def median_groups_fit(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    return {x: v for x, (v,) in exact_quantiles(df, list(cols), [0.5]).items()}


def median_groups(df: DataFrame, medians: dict[str, float], name: str = "median_group") -> DataFrame:
    """Binary number of the columns above their median, plus 1; the first column has the highest bit."""
    bits = [F.when(F.col(x) > m, 1 << (len(medians) - 1 - i)).otherwise(0) for i, (x, m) in enumerate(medians.items())]
    return df.withColumn(name, (sum(bits, F.lit(0)) + 1).cast("int"))


def qcut_fit(df: DataFrame, col: str, n: int) -> list[float]:
    """Linear quantile edges without repeats."""
    return sorted(set(exact_quantiles(df, col, [i / n for i in range(n + 1)])))


def qcut_groups(df: DataFrame, col: str, edges: Sequence[float], name: str) -> DataFrame:
    """Bins from 0, closed on the right, the first also on the left."""
    return df.withColumn(name, bin_of(col, edges, "clip") - 1)


def median_label_groups(df: DataFrame, medians: dict[str, float], name: str = "label") -> DataFrame:
    parts = [F.concat(F.lit(f"{x}: "), F.when(F.col(x) > m, "Above Median").otherwise("Below Median")) for x, m in medians.items()]
    return df.withColumn(name, F.concat_ws(", ", *parts))


# --- regressions --------------------------------------------------------------------------------------------------------


def _design(df: DataFrame, x: Sequence[str], fe: Sequence[str], levels: dict[str, list]) -> dict[str, Column]:
    out = {"const": F.lit(1.0)} | {c: F.col(c).cast("double") for c in x}
    return out | {f"{c}={v}": (F.col(c) == v).cast("double") for c in fe for v in levels[c]}


def groupwise_ols(df: DataFrame, y: str, x: Sequence[str], group: Sequence[str], fe: Sequence[str] = (), min_size: int = 10) -> DataFrame:
    """Least squares y ~ x + C(fe) in each group: group, coefficients (map), n, r2, rmse, mae, mape.

    Each task adds up products of design columns; the sums of a group, not its rows, are solved (by pseudo-inverse, so
    that fixed-effect levels which a group lacks get 0). A second pass with the joined coefficients gives mae and mape.
    Groups of fewer than min_size rows are left out.
    """
    levels = {c: sorted(v for v in df.agg(F.collect_set(c)).first()[0])[1:] for c in fe}
    cols = _design(df, x, fe, levels)
    names = list(cols)
    base = df.dropna(subset=[y, *x, *fe, *group]).select(*group, F.col(y).cast("double").alias("_y"), F.array(*cols.values()).alias("_x"))
    p = len(names)
    sums = [F.sum(F.col("_x")[i] * F.col("_x")[j]) for i in range(p) for j in range(i, p)]
    rhs = [F.sum(F.col("_x")[i] * F.col("_y")) for i in range(p)]
    moments = base.groupBy(*group).agg(F.array(*sums).alias("_g"), F.array(*rhs).alias("_r"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"), F.sum("_y").alias("_sy"), F.count("*").alias("n")).where(F.col("n") >= min_size)

    @F.pandas_udf("b array<double>, sse double")
    def solved(g: pd.Series, b: pd.Series, yy: pd.Series) -> pd.DataFrame:
        rows = []
        at = np.triu_indices(p)
        for gi, bi, yi in zip(g, b, yy, strict=True):
            m = np.zeros((p, p))
            m[at] = gi
            m = m + np.triu(m, 1).T
            scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
            w = np.linalg.pinv(m / np.outer(scale, scale), rcond=1e-12, hermitian=True) @ (np.asarray(bi) / scale) / scale
            rows.append((w, max(0.0, float(yi - 2 * w @ bi + w @ m @ w))))
        return pd.DataFrame({"b": pd.Series([r[0] for r in rows], dtype=object), "sse": [r[1] for r in rows]})

    fits = moments.withColumn("_s", solved("_g", "_r", "_yy")).select(*group, "n", F.col("_s.b").alias("_b"), F.col("_s.sse").alias("_sse"), (F.col("_yy") - F.col("_sy") * F.col("_sy") / F.col("n")).alias("_sst"))
    fitted = F.aggregate(F.zip_with("_x", "_b", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    errors = base.join(fits, list(group)).withColumn("_e", F.abs(F.col("_y") - fitted)).groupBy(*group).agg(
        F.avg("_e").alias("mae"), F.avg(F.when(F.abs("_y") > 1e-6, F.col("_e") / F.abs("_y"))).alias("mape")
    )
    out = fits.join(errors, list(group))
    return out.select(
        *group, F.map_from_arrays(F.array(*map(F.lit, names)), "_b").alias("coefficients"), "n",
        (1 - F.try_divide("_sse", F.nullif(F.col("_sst"), F.lit(0.0)))).alias("r2"), F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"), "mae", "mape",
    )


def groupwise_me(df: DataFrame, models: DataFrame, q: str, group: Sequence[str], linear: str, square: str) -> DataFrame:
    """ME = a1 + 2 a2 q with the group's coefficients of linear and square; groups without a model get null."""
    c = models.select(*group, F.col("coefficients")[linear].alias("alpha1"), F.col("coefficients")[square].alias("alpha2"))
    return df.join(c, list(group), "left").withColumn("ME", F.col("alpha1") + 2 * F.col("alpha2") * F.col(q))


def gram_sums(df: DataFrame, cols: dict[str, Column], keys: Sequence[str] = ()) -> dict[tuple, np.ndarray]:
    """{values of keys: sums of products of cols} over the rows without nulls in cols, as sums of one aggregation."""
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    base = df.select(*keys, *(c.cast("double").alias(f"_c{i}") for i, c in enumerate(cols.values()))).dropna(subset=[f"_c{i}" for i in range(p)])
    out = {}
    for r in base.groupBy(*keys).agg(*(F.sum(F.col(f"_c{i}") * F.col(f"_c{j}")).alias(f"s{i}_{j}") for i, j in pairs)).collect():
        g = np.zeros((p, p))
        for (i, j), v in zip(pairs, r[len(keys) :], strict=True):
            g[i, j] = g[j, i] = v or 0.0
        out[tuple(r[: len(keys)])] = g
    return out


def solved(g: np.ndarray, penalty: np.ndarray | float = 0.0) -> np.ndarray:
    """Weights of the columns before the last, which is the target, by (penalised) least squares from sums of products."""
    return np.linalg.pinv(g[:-1, :-1] + penalty, rcond=1e-12, hermitian=True) @ g[:-1, -1]


def squared_error(g: np.ndarray, w: np.ndarray) -> float:
    e = np.append(-w, 1.0)
    return max(0.0, float(e @ g @ e))


@dataclass(frozen=True)
class PolyDesign:
    """Columns 1, z^k, and of each driver d and z d, and controls as they are (as time terms); z = (q - mean) / sigma.
    Drivers in scales are standardised by their (mean, deviation)."""

    q: str
    mean: float
    sigma: float
    degree: int
    interactions: tuple[str, ...] = ()
    controls: tuple[str, ...] = ()
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, q: str, degree: int, interactions: Sequence[str] = (), controls: Sequence[str] = (), standard: bool = False) -> PolyDesign:
        seen = [q, *(interactions if standard else ())]
        row = df.agg(*(f(x) for x in seen for f in (F.avg, F.stddev_pop))).first()
        scale = {x: (float(row[2 * i] or 0.0), float(row[2 * i + 1] or 0.0) or 1.0) for i, x in enumerate(seen)}
        return cls(q, *scale[q], degree, tuple(interactions), tuple(controls), {d: scale[d] for d in interactions} if standard else {})

    def _z(self) -> Column:
        return (F.col(self.q) - self.mean) / self.sigma

    def _driver(self, d: str) -> Column:
        m, s = self.scales.get(d, (0.0, 1.0))
        return (F.col(d) - m) / s if d in self.scales else F.col(d).cast("double")

    def columns(self) -> dict[str, Column]:
        z = self._z()
        out = {"const": F.lit(1.0)} | {f"z{k}": F.pow(z, F.lit(float(k))) for k in range(1, self.degree + 1)}
        out |= {f"z*{d}": z * self._driver(d) for d in self.interactions} | {d: self._driver(d) for d in self.interactions}
        return out | {d: F.col(d).cast("double") for d in self.controls}


@dataclass(frozen=True)
class PolyModel(PolyDesign):
    """A design with its coefficients, the penalty they were fitted with, and, where it was chosen by folds, the mean
    squared error of each penalty in the folds left out."""

    coefficients: dict[str, float] = field(default_factory=dict)
    alpha: float = 0.0
    scores: dict[float, float] = field(default_factory=dict)

    @classmethod
    def of(cls, design: PolyDesign, w: np.ndarray, alpha: float = 0.0, scores: dict[float, float] | None = None) -> PolyModel:
        own = {f: getattr(design, f) for f in ("q", "mean", "sigma", "degree", "interactions", "controls", "scales")}
        return cls(**own, coefficients=dict(zip(design.columns(), map(float, w), strict=True)), alpha=alpha, scores=scores or {})

    def predict(self) -> Column:
        return sum((self.coefficients[k] * c for k, c in self.columns().items()), F.lit(0.0))

    def me(self) -> Column:
        """dy/dq."""
        z, c = self._z(), self.coefficients
        out = sum((k * c[f"z{k}"] * F.pow(z, F.lit(float(k - 1))) for k in range(1, self.degree + 1)), F.lit(0.0))
        return (out + sum((c[f"z*{d}"] * self._driver(d) for d in self.interactions), F.lit(0.0))) / self.sigma


def _ridge(p: int, alpha: float) -> np.ndarray:
    """alpha for each weight but that of the intercept."""
    return alpha * np.diag(np.append(0.0, np.ones(p - 1)))


def poly_ols(df: DataFrame, q: str, y: str, degree: int = 2, interactions: Sequence[str] = (), controls: Sequence[str] = (), ridge: float = 0.0, standard: bool = False) -> PolyModel:
    """Least squares (with ridge: plus ridge times the squared coefficients but the intercept) from one Gram aggregation."""
    design = PolyDesign.fit(df, q, degree, interactions, controls, standard)
    cols = design.columns()
    g = gram_sums(df, cols | {"": F.col(y)}).get((), np.zeros((len(cols) + 1,) * 2))
    return PolyModel.of(design, solved(g, _ridge(len(cols), ridge)), ridge)


def poly_ridge(df: DataFrame, q: str, y: str, degree: int = 2, interactions: Sequence[str] = (), controls: Sequence[str] = (), alphas: Sequence[float] = (0.1, 1.0, 10.0), folds: int = 5, standard: bool = False) -> PolyModel:
    """The alpha with the least squared error over hashed folds; each fold's Gram sums come from one grouped pass."""
    design = PolyDesign.fit(df, q, degree, interactions, controls, standard)
    cols = design.columns()
    fold = F.pmod(F.xxhash64(*df.columns), F.lit(folds))
    parts = list(gram_sums(df.withColumn("_fold", fold), cols | {"": F.col(y)}, ["_fold"]).values())
    total = sum(parts)
    loss = lambda a: sum(squared_error(g, solved(total - g, _ridge(len(cols), a))) for g in parts) / max(1.0, total[0, 0])
    scores = {float(a): float(loss(a)) for a in alphas}
    best = min(scores, key=scores.get)
    return PolyModel.of(design, solved(total, _ridge(len(cols), best)), best, scores)


@dataclass(frozen=True)
class _HuberSums:
    """Sums at one point (weights, scale): products over the rows within epsilon * scale, signed columns of the others."""

    loss: float
    inner: np.ndarray
    signs: np.ndarray
    n: int
    n_outer: int


def _huber_sums(df: DataFrame, cols: dict[str, Column], y: str, w: np.ndarray, scale: float, epsilon: float, alpha: float) -> _HuberSums:
    names = list(cols)
    base = df.select(*(c.cast("double").alias(f"_c{i}") for i, c in enumerate(cols.values())), F.col(y).cast("double").alias("_y")).dropna()
    at = base.withColumn("_r", F.col("_y") - sum((F.col(f"_c{i}") * float(w[i]) for i in range(len(names))), F.lit(0.0)))
    near = F.abs("_r") <= epsilon * scale
    x = [F.when(near, F.col(f"_c{i}")) for i in range(len(names))] + [F.when(near, F.col("_y"))]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = at.agg(
        F.count("*"), F.count_if(near), F.sum(F.when(near, F.col("_r") * F.col("_r"))), F.sum(F.when(~near, F.abs("_r"))),
        *(F.sum(F.when(~near, F.signum("_r") * F.col(f"_c{i}"))) for i in range(len(names))), *(F.sum(x[i] * x[j]) for i, j in pairs),
    ).first()
    n, inside, squares, far = row[0], row[1], row[2] or 0.0, row[3] or 0.0
    g = np.zeros((len(x), len(x)))
    for (i, j), v in zip(pairs, row[4 + len(names) :], strict=True):
        g[i, j] = g[j, i] = v or 0.0
    loss = n * scale + squares / scale + 2 * epsilon * far - epsilon**2 * scale * (n - inside) + alpha * float(w[1:] @ w[1:])
    return _HuberSums(loss, g, np.array([v or 0.0 for v in row[4 : 4 + len(names)]]), n, n - inside)


def _huber_step(s: _HuberSums, epsilon: float, alpha: float, scale: float) -> tuple[np.ndarray, float]:
    """The weights and scale that are best if no row crosses the threshold."""
    w = np.zeros(len(s.signs))
    free = s.n - epsilon**2 * s.n_outer
    for _ in range(200):
        w = np.linalg.pinv(s.inner[:-1, :-1] + _ridge(len(w), alpha * scale), rcond=1e-12, hermitian=True) @ (s.inner[:-1, -1] + epsilon * scale * s.signs)
        # with so many rows outside a larger scale is always better
        new = max(1e-12, np.sqrt(squared_error(s.inner, w) / free)) if free > 0 else 2 * scale
        if free <= 0 or abs(new - scale) <= 1e-13 * scale:
            return w, new
        scale = new
    return w, scale


def poly_huber(
    df: DataFrame, q: str, y: str, degree: int = 2, interactions: Sequence[str] = (), controls: Sequence[str] = (), epsilon: float = 1.35, alpha: float = 1e-4, rounds: int = 60, standard: bool = False
) -> PolyModel:
    """Huber loss, minimised over weights and scale together: the sum of scale + H(e / scale) * scale, H(x) being x^2
    up to epsilon and 2 epsilon |x| - epsilon^2 beyond, plus alpha times the squared weights but the intercept.

    Each round is one aggregation at a point: its loss, the sums of products of the rows within epsilon scales and the
    signed sums of the others. From these the driver takes the best point with the same rows inside; where the loss there
    is higher, half of the way. The loss is convex and the rows inside soon stay, so rounds are few.
    """
    design = PolyDesign.fit(df, q, degree, interactions, controls, standard)
    return PolyModel.of(design, huber_weights(df, design.columns(), y, epsilon, alpha, rounds)[0], alpha)


def huber_weights(df: DataFrame, cols: dict[str, Column], y: str, epsilon: float = 1.35, alpha: float = 1e-4, rounds: int = 60) -> tuple[np.ndarray, float]:
    """(weights of cols, the first of which is 1, and the scale) of the least Huber loss; see poly_huber."""
    g = gram_sums(df, cols | {"": F.col(y)}).get((), np.zeros((len(cols) + 1,) * 2))
    w = solved(g)
    scale = max(1e-12, np.sqrt(squared_error(g, w) / max(1.0, g[0, 0])))
    at = _huber_sums(df, cols, y, w, scale, epsilon, alpha)
    for _ in range(rounds):
        w1, s1 = _huber_step(at, epsilon, alpha, scale)
        part, then = 1.0, None
        while part > 1e-6:
            there = w + part * (w1 - w), scale + part * (s1 - scale)
            then = _huber_sums(df, cols, y, *there, epsilon, alpha)
            if then.loss <= at.loss * (1 + 1e-14):
                break
            part /= 2
        moved = np.abs(there[0] - w).max() / max(1e-12, np.abs(w).max()) + abs(there[1] - scale) / scale
        (w, scale), at = there, then
        if moved < 1e-10:
            break
    return w, scale


@dataclass(frozen=True)
class SplineModel:
    """Cubic B-splines with equal knots on the training range for q and each smooth, and linear terms."""

    q: str
    knots: dict[str, tuple[float, float, int]]
    coefficients: tuple[float, ...]
    linear: tuple[str, ...] = ()
    penalty: float = 0.0
    scores: dict[float, float] = field(default_factory=dict)

    def _spline(self, x: str, at: int, derivative: bool = False) -> Column:
        lo, hi, n = self.knots[x]
        k, w, h = _interval(F.col(x), lo, hi, n)
        c = F.array(*map(F.lit, self.coefficients[at : at + n]))
        out = sum((F.element_at(c, k + 1 + j) * v for j, v in enumerate(_cubic(w, derivative))), F.lit(0.0))
        return out / h if derivative else out

    def predict(self) -> Column:
        out, at = F.lit(self.coefficients[0]), 1
        for x, (_, _, n) in self.knots.items():
            out, at = out + self._spline(x, at), at + n
        return out + sum((c * F.col(x) for c, x in zip(self.coefficients[at:], self.linear, strict=True)), F.lit(0.0))

    def me(self) -> Column:
        """Derivative by q, the first spline."""
        return self._spline(self.q, 1, True)


def _interval(x: Column, lo: float, hi: float, n: int) -> tuple[Column, Column, float]:
    """(number of the interval of x, place in it from 0 to 1, its length); x is clipped to the range."""
    h = (hi - lo) / (n - 3)
    u = (F.least(F.greatest(x, F.lit(lo)), F.lit(hi)) - lo) / h
    k = F.least(F.floor(u), F.lit(n - 4)).cast("int")
    return k, u - k, h


def _cubic(w: Column, derivative: bool = False) -> tuple[Column, ...]:
    """The four uniform cubic B-splines over an interval, or their derivatives by w."""
    if derivative:
        return -(1 - w) * (1 - w) / 2, (9 * w * w - 12 * w) / 6, (-9 * w * w + 6 * w + 3) / 6, w * w / 2
    return (1 - w) * (1 - w) * (1 - w) / 6, (3 * w * w * w - 6 * w * w + 4) / 6, (-3 * w * w * w + 3 * w * w + 3 * w + 1) / 6, w * w * w / 6


def spline_knots(df: DataFrame, xs: Sequence[str], n: int) -> dict[str, tuple[float, float, int]]:
    row = df.agg(*(e for x in xs for e in (F.min(x), F.max(x)))).first()
    ends = [(float(row[2 * i]), float(row[2 * i + 1])) for i in range(len(xs))]
    return {x: (lo, hi if hi > lo else lo + 1.0, n) for x, (lo, hi) in zip(xs, ends, strict=True)}


def spline_sums(df: DataFrame, knots: dict[str, tuple[float, float, int]], linear: Sequence[str], y: str, keys: Sequence[str] = ()) -> dict[tuple, np.ndarray]:
    """{values of keys: sums of products} of 1, all splines, the linear columns and y, over rows without nulls in them.

    At most four splines of a variable are not 0 at a place, so the rows of each pair of intervals of two variables
    have 4 x 4 products: these are summed by pair of intervals, and the driver puts the blocks together. With several
    variables each row counts in all pairs of them.
    """
    names, dense = list(knots), [F.lit(1.0), *(F.col(x).cast("double") for x in linear), F.col(y).cast("double")]
    parts = {x: _interval(F.col(x).cast("double"), *knots[x]) for x in names}
    cols = {f"k{i}": parts[x][0] for i, x in enumerate(names)} | {f"b{i}_{j}": v for i, x in enumerate(names) for j, v in enumerate(_cubic(parts[x][1]))}
    base = df.dropna(subset=[*names, *linear, y]).select(*keys, *(c.alias(f"_{n}") for n, c in cols.items()), *(c.alias(f"_d{i}") for i, c in enumerate(dense)))
    pairs = [(a, b) for a in range(len(names)) for b in range(a, len(names))]
    one = lambda a, b: F.struct(F.lit(a).alias("_a"), F.lit(b).alias("_b"), F.col(f"_k{a}").alias("_ka"), F.col(f"_k{b}").alias("_kb"), *(F.col(f"_b{a}_{j}").alias(f"_u{j}") for j in range(4)), *(F.col(f"_b{b}_{j}").alias(f"_v{j}") for j in range(4)))
    d = [f"_d{i}" for i in range(len(dense))]
    base = base.select(*keys, *d, F.inline(F.array(*(one(a, b) for a, b in pairs))))
    sums = [F.sum(F.col(f"_u{i}") * F.col(f"_v{j}")) for i in range(4) for j in range(4)]
    sums += [F.sum(F.col(f"_u{i}") * F.col(x)) for i in range(4) for x in d]
    sums += [F.sum(F.col(d[i]) * F.col(d[j])) for i in range(len(d)) for j in range(len(d))]
    rows = base.groupBy(*keys, "_a", "_b", "_ka", "_kb").agg(*(s.alias(f"_s{i}") for i, s in enumerate(sums))).collect()
    starts = np.cumsum([1, *(n for _, _, n in knots.values())])
    rest = np.append(0, np.arange(starts[-1], starts[-1] + len(d) - 1))  # places of the dense columns
    out: dict[tuple, np.ndarray] = {}
    for r in rows:
        g = out.setdefault(tuple(r[: len(keys)]), np.zeros((starts[-1] + len(d) - 1,) * 2))
        a, b, ka, kb = r[len(keys) : len(keys) + 4]
        s = np.array(r[len(keys) + 4 :], float)
        u, v = starts[a] + ka + np.arange(4), starts[b] + kb + np.arange(4)
        block = s[:16].reshape(4, 4)
        g[np.ix_(u, v)] += block
        if a != b:
            g[np.ix_(v, u)] += block.T
        else:
            side = s[16 : 16 + 4 * len(d)].reshape(4, -1)
            g[np.ix_(u, rest)] += side
            g[np.ix_(rest, u)] += side.T
            if a == 0:
                g[np.ix_(rest, rest)] += s[16 + 4 * len(d) :].reshape(len(d), -1)
    return out


def spline_solved(g: np.ndarray, knots: dict[str, tuple[float, float, int]], penalties: Sequence[float], keep: Sequence[int] | None = None) -> tuple[np.ndarray, float, dict[float, float]]:
    """(weights, the penalty of the least generalised cross-validation score, the scores) from sums of products; keep:
    the columns that take part. Second differences of the weights of each spline are penalised."""
    keep = list(range(len(g) - 1)) if keep is None else list(keep)
    pen, at = np.zeros((len(g) - 1,) * 2), 1
    for _, _, n in knots.values():
        second = np.diff(np.eye(n), 2, axis=0)
        pen[at : at + n, at : at + n] = second.T @ second
        at += n
    own, pen, n = g[np.ix_([*keep, -1], [*keep, -1])], pen[np.ix_(keep, keep)], max(1.0, g[0, 0])
    fits, scores = {}, {}
    for p in penalties:
        inverse = np.linalg.pinv(own[:-1, :-1] + p * pen, rcond=1e-12, hermitian=True)
        fits[p] = inverse @ own[:-1, -1]
        used = min(float(np.trace(inverse @ own[:-1, :-1])), n - 1e-9)
        scores[float(p)] = n * squared_error(own, fits[p]) / (n - used) ** 2
    best = min(penalties, key=lambda p: scores[float(p)])
    return fits[best], float(best), scores


def spline_fit(df: DataFrame, q: str, y: str, smooths: Sequence[str] = (), linear: Sequence[str] = (), n: int = 10, penalty: float | Sequence[float] = 10.0) -> SplineModel:
    """Penalised least squares from sums over pairs of intervals; of several penalties the one of the least generalised
    cross-validation score, from the same sums."""
    knots = spline_knots(df, [q, *smooths], n)
    size = 1 + n * len(knots) + len(linear) + 1
    g = spline_sums(df, knots, linear, y).get((), np.zeros((size, size)))
    w, best, scores = spline_solved(g, knots, [penalty] if isinstance(penalty, (int, float)) else list(penalty))
    return SplineModel(q, knots, tuple(map(float, w)), tuple(linear), best, scores)


# --- scores -------------------------------------------------------------------------------------------------------------


def point_metrics(df: DataFrame, y: str, p: str, group: Sequence[str] = (), eps: float = 1e-6, weight: str | None = None) -> DataFrame:
    """r2, rmse, mae, mape, n overall or in each group; with weight also the weighted r2."""
    e = F.col(y) - F.col(p)
    w = F.col(weight) if weight else F.lit(1.0)
    out = df.dropna(subset=[y, p]).groupBy(*group).agg(
        F.count("*").alias("n"), F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count("*")).alias("_sst"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(F.abs(y) > eps, F.abs(e) / F.abs(y))).alias("mape"),
        F.sum(w * e * e).alias("_wsse"), (F.sum(w * F.col(y) * F.col(y)) - F.pow(F.sum(w * F.col(y)), F.lit(2.0)) / F.sum(w)).alias("_wsst"),
    )
    r2 = lambda a, b: 1 - F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0)))
    cols = [*group, r2("_sse", "_sst").alias("r2"), F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"), "mae", "mape", "n"]
    return out.select(*cols, *([r2("_wsse", "_wsst").alias("energy_r2")] if weight else []))


def macro_micro_means(df: DataFrame, metrics: Sequence[str], n: str = "n", by: Sequence[str] = (), energy: str | None = None) -> DataFrame:
    """Mean over groups, and means weighted by rows and by energy; null and NaN metrics don't count."""
    def weighted(x: str, w: str) -> Column:
        ok = F.col(x).isNotNull() & ~F.isnan(x)
        return F.try_divide(F.sum(F.when(ok, F.col(x) * F.col(w))), F.sum(F.when(ok, F.col(w))))

    cols = [F.avg(F.nanvl(F.col(x), F.lit(None).cast("double"))).alias(f"{x}_macro") for x in metrics] + [weighted(x, n).alias(f"{x}_micro") for x in metrics]
    return df.groupBy(*by).agg(*cols, *([weighted(x, energy).alias(f"{x}_energy") for x in metrics] if energy else []))


def summarise_metrics(df: DataFrame, metrics: Sequence[str], split: str = "split", group: str = "group_id") -> DataFrame:
    """Macro and micro means by split, and the metrics of each group as JSON."""
    nested = df.groupBy(split).agg(F.to_json(F.array_sort(F.collect_list(F.struct(group, "n", *metrics)))).alias("metrics_by_group"))
    return macro_micro_means(df, metrics, "n", [split]).join(nested, split)


def energy_weights(df: DataFrame, q: str, group: Sequence[str], hours: float = 0.5) -> DataFrame:
    return df.groupBy(*group).agg((F.sum(q) * hours).alias("energy"))


def ramp_pairs(df: DataFrame, q: str, y: str, me: str, keys: Sequence[str] = ("city",), ts: str = "timestamp", max_minutes: float = 60, min_abs_dq: float = 0.0) -> DataFrame:
    """keys, timestamp, minutes, dq, dy, s = dy/dq, m = mean ME of consecutive rows that are close in time and far enough in q."""
    w = Window.partitionBy(*keys).orderBy(ts)
    diff = lambda x: F.col(x) - F.lag(x).over(w)
    out = df.select(*keys, ts, (F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts)) / 60).alias("minutes"), diff(q).alias("dq"), diff(y).alias("dy"), ((F.col(me) + F.lag(me).over(w)) / 2).alias("m"))
    near = (F.col("minutes") > 0) & (F.col("minutes") <= max_minutes) & (F.abs("dq") >= max(min_abs_dq, 1e-12))
    return out.where(near).withColumn("s", F.col("dy") / F.col("dq"))


def ramp_scores(pairs: DataFrame, by: Sequence[str] = ("city",)) -> DataFrame:
    """Pearson, Spearman, rmse, mae and n of s against m, in each group or over all."""
    ok = pairs.where(F.col("m").isNotNull() & F.col("s").isNotNull()).select(*by, "s", "m")
    ranked = average_ranks(ok, {"s": "_rs", "m": "_rm"}, by)
    e = F.col("s") - F.col("m")
    return ranked.groupBy(*by).agg(F.corr("s", "m").alias("pearson"), F.corr("_rs", "_rm").alias("spearman"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n_pairs"))


def finite_difference_metrics(df: DataFrame, q: str, y: str, me: str, keys: Sequence[str] = ("city",), ts: str = "timestamp", max_minutes: float = 60, min_abs_dq: float = 0.0) -> DataFrame:
    """Ramp scores of each city, and pooled (city 'ALL')."""
    pairs = ramp_pairs(df, q, y, me, keys, ts, max_minutes, min_abs_dq)
    # a group and all groups together are ranked in one pass
    both = pairs.select("s", "m", F.inline(F.array(F.struct(*keys, F.lit(False).alias("_pooled")), F.struct(*(F.lit("ALL").alias(k) for k in keys), F.lit(True).alias("_pooled")))))
    return ramp_scores(both, [*keys, "_pooled"]).drop("_pooled")


def calibrate_wls(pairs: DataFrame) -> tuple[float, float]:
    """(a, b) of s = a + b m, weighted by |dq|, from weighted moment sums. Our own definition."""
    w, m, s = F.abs("dq"), F.col("m"), F.col("s")
    r = pairs.where("m is not null").agg(F.sum(w), F.sum(w * m), F.sum(w * s), F.sum(w * m * m), F.sum(w * m * s)).first()
    sw, sm, ss, smm, sms = (x or 0.0 for x in r)
    d = sw * smm - sm * sm
    b = (sw * sms - sm * ss) / d if d else 0.0
    return (ss - b * sm) / sw if sw else 0.0, b


def calibrated(df: DataFrame, ab: tuple[float, float], me: str = "ME") -> DataFrame:
    return df.withColumn(f"{me}_cal", F.lit(ab[0]) + ab[1] * F.col(me))


def national_median(df: DataFrame, cols: Sequence[str], ts: str = "timestamp") -> DataFrame:
    return df.groupBy(ts).agg(*(F.percentile(x, F.lit(0.5)).alias(x) for x in cols))


def confidence_table(pairs: DataFrame, steps: Sequence[float]) -> DataFrame:
    """tau, r: correlation of s and m over the pairs with |dq| >= tau. Our own definition."""
    cols = [F.corr(F.when(F.abs("dq") >= t, F.col("s")), F.when(F.abs("dq") >= t, F.col("m"))).alias(f"t{i}") for i, t in enumerate(steps)]
    row = pairs.agg(*cols)
    long = row.unpivot([], [f"t{i}" for i in range(len(steps))], "name", "r")
    taus = F.array(*map(F.lit, map(float, steps)))
    return long.select(F.element_at(taus, F.substring("name", 2, 9).cast("int") + 1).alias("tau"), "r")


def confidence_label(df: DataFrame, table: DataFrame, dq: str = "dq", low: float = 0.40, high: float = 0.60) -> DataFrame:
    """df with r of the largest tau up to |dq|, and low, medium or high confidence. The table has few rows."""
    rows = F.broadcast(table.agg(F.array_sort(F.collect_list(F.struct("tau", "r"))).alias("_t")))
    at = F.element_at(F.filter("_t", lambda x: x["tau"] <= F.abs(dq)), -1)["r"]
    ok = F.size(F.filter("_t", lambda x: x["tau"] <= F.abs(dq))) > 0
    out = df.crossJoin(rows).withColumn("r", F.when(ok, at)).drop("_t")
    return out.withColumn("confidence", F.when(F.coalesce("r", F.lit(0.0)) < low, "low").when(F.col("r") < high, "medium").otherwise("high"))


def time_split(df: DataFrame, bounds: Sequence[tuple[str, str, str]], ts: str = "timestamp") -> DataFrame:
    """df with split: the name of the half-open range (name, start, end) that ts is in; other rows go."""
    expr = F.lit(None).cast("string")
    for name, start, end in bounds:
        expr = F.when((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")), name).otherwise(expr)
    return df.withColumn("split", expr).where("split is not null")


def me_for_split(df: DataFrame, keep: Sequence[str], split: str) -> DataFrame:
    return df.select(*keep, "ME", F.lit(split).alias("split"))


def me_summary(df: DataFrame, by: Sequence[str] = ("split",), me: str = "ME") -> DataFrame:
    out = df.groupBy(*by).agg(F.count(me).alias("n"), F.avg(me).alias("mean"), F.stddev_samp(me).alias("std"), F.min(me).alias("min"), F.max(me).alias("max"))
    return with_quantiles(out, df, by, {"q1": (me, 0.25), "median": (me, 0.5), "q3": (me, 0.75)}).select(*by, "n", "mean", "std", "min", "q1", "median", "q3", "max")


def best_models(results: DataFrame, criterion: str, n: int = 5) -> DataFrame:
    """n results with the smallest 'std', the largest 'mean', or the smallest 'gap' of train and validation."""
    order = {"std": F.asc("std"), "mean": F.desc("mean"), "gap": F.asc(F.abs(F.col("train") - F.col("validation"))) if "train" in results.columns else None}[criterion]
    return results.orderBy(order, "config").limit(n)


# --- configurations -----------------------------------------------------------------------------------------------------


def config_hash(config: dict) -> str:
    """SHA-256 of canonical JSON."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def hash_column(df: DataFrame, cols: Sequence[str], name: str = "config") -> DataFrame:
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*sorted(cols))), 256))


@dataclass(frozen=True)
class Preprocess:
    """Feature steps in their fixed order: winsorise, log1p, polynomial, standardise, one-hot."""

    winsorize: tuple[str, ...] = ()
    log1p: tuple[str, ...] = ()
    polynomial: tuple[str, int] | None = None
    standardise: tuple[str, ...] = ()
    onehot: tuple[str, ...] = ()
    robust: bool = False
    fitted: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Preprocess:
        from wattloom.functions import columns as C

        done: dict = {}
        if self.winsorize:
            done["winsorize"] = C.winsorize_fit(df, self.winsorize)
        step = Preprocess(self.winsorize, self.log1p, self.polynomial, fitted=done).apply(df)
        if self.standardise:
            done["standardise"] = C.standardise_fit(step, self.standardise, self.robust)
        if self.onehot:
            done["onehot"] = C.onehot_fit(df, self.onehot)
        return Preprocess(self.winsorize, self.log1p, self.polynomial, self.standardise, self.onehot, self.robust, done)

    def apply(self, df: DataFrame) -> DataFrame:
        from wattloom.functions import columns as C

        if "winsorize" in self.fitted:
            df = C.winsorize(df, self.fitted["winsorize"])
        df = df.withColumns({x: C.log1p_clamped(x) for x in self.log1p})
        if self.polynomial:
            df = C.polynomial_interactions(df, *self.polynomial)
        if "standardise" in self.fitted:
            df = C.standardise(df, self.fitted["standardise"])
        return C.onehot(df, self.fitted["onehot"]) if "onehot" in self.fitted else df

    def as_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "fitted"}


def evaluate_model(df: DataFrame, y: str, p: str, q: str, me: str, group: Sequence[str], keys: Sequence[str] = ("city",), ts: str = "timestamp", max_minutes: float = 60) -> dict[str, DataFrame]:
    """Overall, group and ramp scores, and the predictions, of one split."""
    return {
        "overall": point_metrics(df, y, p), "by_group": point_metrics(df, y, p, group),
        "ramps": finite_difference_metrics(df, q, y, me, keys, ts, max_minutes), "predictions": df.select(*keys, ts, y, p, me),
    }


def search_models(df: DataFrame, y: str, q: str, bins: Sequence[dict[str, int]], controls: Sequence[Sequence[str]], done: Sequence[str] = (), min_size: int = 10) -> DataFrame:
    """search_families over all combinations of bins and controls, on all rows: a row for each that isn't done yet."""
    configs = [{"bins": dict(spec), "controls": list(extra)} for spec, extra in itertools.product(bins, controls)]
    return search_families(df, y, q, configs, done=done, min_size=min_size).drop("family", "split")


@dataclass
class _Candidate:
    """A configuration: its predictions over the columns of its scan, by group of rows, as weights of these columns."""

    key: str
    config: dict
    weights: dict[int, np.ndarray]


@dataclass
class _Scan:
    """Rows that several configurations read together: df with _split and _group, columns, sums of products (the last is
    the target) by split and group, the configurations fitted on them, and, where there is one group, their predictions."""

    df: DataFrame
    columns: dict[str, Column]
    sums: dict[tuple, np.ndarray]
    fitted: list[_Candidate]
    predictions: list[Column] | None = None


def _bin_scan(df: DataFrame, y: str, q: str, edges: dict, todo: list[tuple[str, dict]], fit_on: str, min_size: int) -> _Scan:
    controls = list(dict.fromkeys(c for _, config in todo for c in config.get("controls", ())))
    cols = {"const": F.lit(1.0), q: F.col(q), "_q2": F.col(q) * F.col(q)} | {c: F.col(c) for c in controls}
    rows = quantile_bins(df, edges, name="_group")
    sums = gram_sums(rows, cols | {"": F.col(y)}, ["_split", "_group"])
    fitted = []
    for key, config in todo:
        at = [list(cols).index(c) for c in ("const", q, "_q2", *config.get("controls", ()))]
        weights = {}
        for (split, group), g in sums.items():
            if split == fit_on and group is not None and g[0, 0] >= min_size:
                own = g[np.ix_([*at, -1], [*at, -1])]
                scale = np.sqrt(np.maximum(np.diag(own), 1e-300))
                w = np.zeros(len(cols))
                w[at] = solved(own / np.outer(scale, scale)) / scale[:-1] * scale[-1]
                weights[group] = w
        fitted.append(_Candidate(key, config, weights))
    return _Scan(rows, cols, sums, fitted)


def _poly_scan(df: DataFrame, train: DataFrame, y: str, q: str, todo: list[tuple[str, dict]], fit_on: str) -> _Scan:
    """Polynomials, ridge and Huber: all are weights of one union of columns; only Huber fits read the rows again."""
    take = lambda name: list(dict.fromkeys(c for _, config in todo for c in config.get(name, ())))
    design = PolyDesign.fit(train, q, max(config.get("degree", 2) for _, config in todo), take("interactions"), [c for c in take("controls") if c not in take("interactions")], True)
    cols = design.columns()
    rows = df.withColumn("_group", F.lit(0))
    sums = gram_sums(rows, cols | {"": F.col(y)}, ["_split", "_group"])
    g = sums.get((fit_on, 0), np.zeros((len(cols) + 1,) * 2))
    fitted = []
    for key, config in todo:
        own = PolyDesign(q, design.mean, design.sigma, config.get("degree", 2), tuple(config.get("interactions", ())), tuple(config.get("controls", ())), design.scales)
        at = [list(cols).index(c) for c in own.columns()]
        w = np.zeros(len(cols))
        if config["family"] == "huber":
            # of the same rows as the others: those without nulls in the union of columns
            whole = train.select("*", *(c.cast("double").alias(f"_u{i}") for i, c in enumerate(cols.values()))).dropna(subset=[f"_u{i}" for i in range(len(cols))])
            w[at] = huber_weights(whole, {k: cols[k] for k in own.columns()}, y, config.get("epsilon", 1.35), config.get("alpha", 1e-4))[0]
        else:
            w[at] = solved(g[np.ix_([*at, -1], [*at, -1])], _ridge(len(at), config.get("alpha", 0.0)))
        fitted.append(_Candidate(key, config, {0: w}))
    return _Scan(rows, cols, sums, fitted)


def _spline_scan(df: DataFrame, train: DataFrame, y: str, q: str, smooths: tuple[str, ...], n: int, todo: list[tuple[str, dict]], fit_on: str) -> _Scan:
    linear = list(dict.fromkeys(c for _, config in todo for c in config.get("controls", ())))
    knots = spline_knots(train, [q, *smooths], n)
    rows = df.withColumn("_group", F.lit(0))
    sums = spline_sums(rows, knots, linear, y, ["_split", "_group"])
    # columns that must not be null; the weights are of 1, the splines and the linear columns
    cols = {c: F.col(c) for c in (q, *smooths, *linear)}
    names = ["", *(f"{x}[{j}]" for x in knots for j in range(n)), *linear]
    fitted = []
    for key, config in todo:
        keep = [i for i, c in enumerate(names) if c not in linear or c in config.get("controls", ())]
        w = np.zeros(len(names))
        if (fit_on, 0) in sums:
            w[keep] = spline_solved(sums[fit_on, 0], knots, [config.get("penalty", 10.0)], keep)[0]
        fitted.append(_Candidate(key, config, {0: w}))
    return _Scan(rows, cols, sums, fitted, [SplineModel(q, knots, tuple(map(float, c.weights[0])), tuple(linear)).predict() for c in fitted])


def _absolute_errors(scan: _Scan, y: str) -> dict[tuple, list[float]]:
    """{(split, group): summed absolute errors of each configuration}, in one reading of the rows."""
    names = list(scan.columns)
    if scan.predictions is not None:
        errors = [F.abs(F.col(y).cast("double") - p).alias(f"_e{k}") for k, p in enumerate(scan.predictions)]
        whole = scan.df.dropna(subset=[y, *scan.columns]).select("_split", "_group", *errors)
        return {(r[0], r[1]): r[2:] for r in whole.groupBy("_split", "_group").agg(*(F.sum(f"_e{k}") for k in range(len(errors)))).collect()}
    base = scan.df.select("_split", "_group", F.col(y).cast("double").alias("_y"), *(c.cast("double").alias(f"_c{i}") for i, c in enumerate(scan.columns.values()))).dropna()
    groups = sorted({g for c in scan.fitted for g in c.weights})
    # a row for each group of bins, as few as the configurations have
    table = [(g, [c.weights[g].tolist() if g in c.weights else None for c in scan.fitted]) for g in groups]
    table = scan.df.sparkSession.createDataFrame(table, "_group int, _w array<array<double>>")
    error = lambda k: F.abs(F.col("_y") - sum((F.col(f"_w{k}")[i] * F.col(f"_c{i}") for i in range(len(names))), F.lit(0.0)))
    joined = base.join(F.broadcast(table.select("_group", *(F.col("_w")[k].alias(f"_w{k}") for k in range(len(scan.fitted))))), "_group")
    return {(r[0], r[1]): r[2:] for r in joined.groupBy("_split", "_group").agg(*(F.sum(error(k)) for k in range(len(scan.fitted)))).collect()}


def search_families(df: DataFrame, y: str, q: str, configs: Sequence[dict], split: str | None = None, fit_on: str = "train", done: Sequence[str] = (), min_size: int = 10) -> DataFrame:
    """A row for each configuration that isn't done yet and each split: config (hash), params_json, family, split, n_groups,
    n_obs, and macro (mean over groups) and micro (by rows) r2, rmse and mae.

    Families: bins {"bins": {column: number}, "controls": [...]}, a fit of y on q, its square and the controls in each
    group of bins with at least min_size rows; {"family": "poly" or "huber", "degree", "interactions", "controls",
    "alpha", "epsilon"} with standardised drivers (alpha over 0: ridge); {"family": "spline", "n", "penalty", "smooths",
    "controls"}. Models, bins, knots and scales are fitted on the rows of the split fit_on (all rows without a split
    column).

    Configurations that share bins, knots, or the polynomial columns are one scan: its sums of products of all their
    columns by split and group are enough to fit each one and to score it on every split; one more reading gives the
    absolute errors. Only Huber fits read the training rows again. A row with a null in any column of a scan counts for
    none of its configurations, so that their scores are of the same rows.
    """
    keyed = []
    for c in configs:
        full = dict(c) | {"y": y, "q": q}
        key = config_hash(full)
        if key not in done and key not in {k for k, _ in keyed}:
            keyed.append((key, full | {"family": full.get("family", "bins")}))
    if not keyed:
        raise ValueError("every configuration is done")
    rows = df.withColumn("_split", F.col(split).cast("string") if split else F.lit(fit_on))
    train = rows.where(F.col("_split") == fit_on)
    of = lambda f: [(k, c) for k, c in keyed if c["family"] in f]
    grouped = lambda todo, by: [(b, [t for t in todo if by(t[1]) == b]) for b in dict.fromkeys(by(c) for _, c in todo)]
    scans = []
    if of({"bins"}):
        specs = grouped(of({"bins"}), lambda c: tuple(sorted(c["bins"].items())))
        # the edges of all bins from one ordering of the values
        probs = sorted({0.0, 1.0, *(i / n for spec, _ in specs for _, n in spec for i in range(1, n))})
        q_of = exact_quantiles(train, list(dict.fromkeys(x for spec, _ in specs for x, _ in spec)), probs, midpoint=True)
        q_of = {x: dict(zip(probs, v, strict=True)) for x, v in q_of.items()}
        for spec, todo in specs:
            edges = {x: sorted({q_of[x][0.0] - 1e-4, *(q_of[x][i / n] for i in range(1, n)), q_of[x][1.0] + 1e-4}) for x, n in todo[0][1]["bins"].items()}
            scans.append(_bin_scan(rows, y, q, edges, todo, fit_on, min_size))
    if of({"poly", "huber"}):
        scans.append(_poly_scan(rows, train, y, q, of({"poly", "huber"}), fit_on))
    for (smooths, n), todo in grouped(of({"spline"}), lambda c: (tuple(c.get("smooths", ())), c.get("n", 10))):
        scans.append(_spline_scan(rows, train, y, q, smooths, n, todo, fit_on))
    out = []
    for scan in scans:
        far = _absolute_errors(scan, y)
        for k, c in enumerate(scan.fitted):
            for s in sorted({s for s, _ in scan.sums if s is not None}):
                scores = []
                for (own, group), g in scan.sums.items():
                    if own == s and group in c.weights:
                        n, sst = g[0, 0], g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
                        sse = squared_error(g, c.weights[group])
                        scores.append((n, 1 - sse / sst if sst > 1e-12 * g[-1, -1] else np.nan, np.sqrt(sse / n), far[s, group][k] / n))
                if scores:
                    n, *metrics = np.array(scores).T
                    mean = lambda m, w: float((m * w)[~np.isnan(m)].sum() / w[~np.isnan(m)].sum()) if (~np.isnan(m)).any() else None
                    shown = {x: v for x, v in c.config.items() if x != "family" or v != "bins"}
                    out.append((c.key, json.dumps(shown, sort_keys=True), c.config["family"], s, *(mean(m, np.ones(len(n))) for m in metrics), *(mean(m, n) for m in metrics), len(n), int(n.sum())))
    names = "config string, params_json string, family string, split string, r2_macro double, rmse_macro double, mae_macro double, r2_micro double, rmse_micro double, mae_micro double, n_groups long, n_obs long"
    return df.sparkSession.createDataFrame(out, names)

"""Quality classifier: Bradley-Terry scores from preference pairs, cut at a quantile of the scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import releasing, stash

#: Bytes of ordinary prose punctuation; other ASCII signs count as symbols.
_PUNCTUATION = b".,;:'\"-()?"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_SYMBOL = ~(_LETTER | _DIGIT | _BLANK)
_SYMBOL[list(_PUNCTUATION)] = False
_KINDS = np.stack([_LETTER, _UPPER, _DIGIT, _SYMBOL, ~(_LETTER | _DIGIT | _BLANK | _SYMBOL)]).astype(np.float64)

FEATURES = (
    "letters", "upper", "digits", "symbols", "punctuation", "log_words", "word_length", "long_word", "distinct_words", "distinct_pairs",
    "repeats", "top_word", "bare_symbols", "odd_ends", "log_lines", "distinct_lines", "short_lines",
)


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes, repetition and shape of a whole text; zeros for null and empty texts."""
    out = np.zeros(len(FEATURES))
    b = (text or "").encode("utf-8", "surrogatepass")
    w = b.split()
    if not w:
        return out
    n = len(w)
    counts = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    out[:5] = _KINDS @ counts / len(b)
    lengths = np.fromiter(map(len, w), np.int64, n)
    ends = np.bincount(np.frombuffer(b"".join(x[-1:] for x in w), np.uint8), minlength=256)
    kinds: dict[bytes, int] = {}
    for x in w:
        kinds[x] = kinds.get(x, 0) + 1
    lines = [x for x in b.split(b"\n") if x.strip()]
    out[5:] = (
        np.log1p(n), lengths.mean(), lengths.max() / 100, len(kinds) / n, len(set(zip(w, w[1:]))) / (n - 1) if n > 1 else 1.0, sum(map(bytes.__eq__, w, w[1:])) / n,
        (max(kinds.values()) - 1) / n, (lengths == 1).mean(), ends[_SYMBOL].sum() / n, np.log1p(len(lines)), len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines),
    )
    return out


def _featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"id": f["id"], "x": pd.Series([features(t) for t in f["text"]], index=f.index, dtype=object)})


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = 100_000, ridge: float = 1e-2, seed: int = 5) -> np.ndarray:
    """Weights w that minimise the logistic loss of w . (x_good - x_bad) over seeded preference pairs, by Newton steps."""
    w = np.zeros(good.shape[1])
    if not len(good) or not len(bad):
        return w
    rng = np.random.default_rng(seed)
    d = good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # how wrong each pair still is
        gradient = d.T @ p / pairs - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


def quality_scores(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, threshold: float = 0.3, sample: int = 30_000
) -> DataFrame:
    """One row for each row of df: id, held_out, score (0 to 1), predicted (1 where score >= threshold).

    Features of whole texts are standardised; a linear score is learned from pairs of a good and a bad row. The cut is
    the quantile of the training scores that leaves the training share of bad rows below; a logistic curve maps the
    cut to threshold. Rows whose crc32(id as text) mod folds is held_fold never train. Training reads a hashed sample
    of about so many labelled rows as sample says.

    Null and empty texts have zero features and get a score like any other. Labels other than 0 and 1 and null ids
    train nothing. With one label only, or none, all scores are equal (and at the cut). Rows that repeat an id are
    scored one by one. Other columns are not read.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held_fold, F.lit(False))
    # the result reads them; a pipeline deletes them when it has written the stage
    x = stash(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(releasing(_featured), f"id {df.schema[id_col].dataType.simpleString()}, x array<double>"), "features")

    marks = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held & F.col(id_col).isNotNull()).withColumnRenamed(id_col, "id")
    part = min(1.0, sample / max(1, marks.count()))
    train = x.join(marks.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 20)) < part * (1 << 20)), "id").select("id", "y", "x").toPandas()
    # in an order that no partitioning changes, as seeded pairs go by place
    train = sorted(zip(train["id"].tolist(), train["y"].tolist(), map(tuple, train["x"]), strict=True))
    rows = np.array([r[2] for r in train]) if train else np.zeros((1, len(FEATURES)))
    y = np.array([r[1] for r in train]) if train else np.ones(1, int)
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((rows - mean) / scale, -8, 8)
    w = bradley_terry(z[y == 1], z[y == 0])
    raw = np.sort(z @ w)
    bad = int((y == 0).sum())
    cut = float((raw[max(bad - 1, 0)] + raw[min(bad, len(raw) - 1)]) / 2)
    level = float(np.log(threshold / (1 - threshold)))

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                s = np.clip((np.stack(f["x"].to_numpy()) - mean) / scale, -8, 8) @ w
                yield pd.DataFrame({"id": f["id"], "score": 1 / (1 + np.exp(-np.clip(s - cut + level + 1e-9, -30, 30)))})

    out = x.mapInPandas(releasing(scored), f"id {df.schema[id_col].dataType.simpleString()}, score double")
    return out.withColumnRenamed("id", id_col).select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text, less exception phrases, by length."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import stash, temporary

#: Letters of other scripts that look like Latin ones, and the digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіѕјһԁԛԝкмтнвαοενρτυικ", "aeopcyxisjhdqwkmthbaoevptuik", strict=True))
DIGITS = dict(zip("0134578", "oieastb", strict=True))
SIGNS = {"@": "a", "$": "s"}

_INNER_SIGN = re.compile(r"[@$](?=[^\W\d_])")


class _Fold(dict):
    """Code point to folded text: letters in lower case and Latin, digits as letters, all else as a space."""

    def __missing__(self, code: int) -> str:
        low = chr(code).lower()
        low = "".join(HOMOGLYPHS.get(c, c) for c in low)
        self[code] = out = DIGITS.get(low, low) if low.isalnum() else "" if code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF) else " "
        return out


_FOLD = _Fold()


def folded(text: str | None) -> list[str]:
    """The folded words of a text. A sign stands for a letter only before another letter."""
    if not text:
        return []
    if "$" in text or "@" in text:
        text = _INNER_SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Lexicon:
    """Folded words with weights, phrases (folded) inside which a word doesn't count, and the logistic curve over
    (summed weight, its square root, weight a hundred words)."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for w, x in self.weights.items():
            a.add_word(f" {w} ", (len(w) + 1, x))
        for p in self.exceptions:
            a.add_word(f" {p} ", (len(p) + 1, None))
        if len(a):
            a.make_automaton()
        return a


def measures(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float, float]:
    """(summed weight of the lexicon words outside exception phrases, its square root, it by a hundred words)."""
    w = folded(text)
    if not w or not len(automaton):
        return 0.0, 0.0, 0.0
    hits, spared = [], []
    for end, (length, weight) in automaton.iter(f" {' '.join(w)} "):
        (spared if weight is None else hits).append((end - length, end, weight or 0.0))
    if spared:
        hits.sort()
        spared.sort()
        left, reach, i = [], -1, 0
        for a, b, x in hits:
            while i < len(spared) and spared[i][0] <= a:
                reach = max(reach, spared[i][1])
                i += 1
            if b > reach:
                left.append((a, b, x))
        hits = left
    total = sum(x for _, _, x in hits)
    return total, total**0.5, 100 * total / len(w)


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word pairs and words of each task with the number of toxic and clean texts that have them."""
    both = Counter(), Counter()
    for f in frames:
        for t, y in zip(f["text"], f["y"], strict=True):
            both[1 - y].update(set(folded(t)))
    at = list(both[0] | both[1])
    yield pd.DataFrame({"word": pd.Series(at, dtype=object), "toxic": [both[0][w] for w in at], "clean": [both[1][w] for w in at]})


def learn_words(train: DataFrame, toxic_rows: int, clean_rows: int, least: float = 24.0, most_words: int = 20_000) -> dict[str, float]:
    """Words whose share of toxic texts is higher, with a log-likelihood ratio of at least least; weight: log odds.

    train: text, y. Counts are summed on the executors, and only the words that pass reach the driver.
    """
    n = train.mapInPandas(_counted, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    p, q = F.lit(float(max(toxic_rows, 1))), F.lit(float(max(clean_rows, 1)))
    share = (F.col("a") + F.col("b")) / (p + q)
    cell = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (cell(F.col("a"), p * share) + cell(F.col("b"), q * share) + cell(p - F.col("a"), p * (1 - share)) + cell(q - F.col("b"), q * (1 - share)))
    odds = F.log((F.col("a") + 0.5) / (p + 1)) - F.log((F.col("b") + 0.5) / (q + 1))
    rows = n.where("a >= 3").select("word", ratio.alias("ratio"), odds.alias("odds")).where((F.col("ratio") >= least) & (F.col("odds") >= 2.0))
    return {r.word: r.odds for r in rows.orderBy(F.desc("ratio"), "word").limit(most_words).collect()}


def learn_exceptions(train: DataFrame, words: dict[str, float], most_phrases: int = 20_000) -> tuple[str, ...]:
    """Pairs of a lexicon word and a neighbour that only clean texts have, in at least three of them."""

    def phrases(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = Counter(), Counter()
        for f in frames:
            for t, y in zip(f["text"], f["y"], strict=True):
                w = folded(t)
                if not words.keys().isdisjoint(w):
                    both[1 - y].update({f"{u} {v}" for u, v in zip(w, w[1:]) if u in words or v in words})
        at = list(both[0] | both[1])
        yield pd.DataFrame({"phrase": pd.Series(at, dtype=object), "toxic": [both[0][w] for w in at], "clean": [both[1][w] for w in at]})

    n = train.mapInPandas(phrases, "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    return tuple(r.phrase for r in n.where("a = 0 and b >= 3").orderBy(F.desc("b"), "phrase").limit(most_phrases).collect())


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression with an intercept, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w)), x.T @ (y - p) / len(x) - ridge * w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return tuple(float(v) for v in w)


def score_texts(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, weight (summed), score (0 to 1)."""
    kind = df.schema[id_col].dataType.simpleString()

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, c = lexicon.automaton(), np.array(lexicon.curve)
        for f in frames:
            m = np.array([measures(t, a) for t in f["text"]]).reshape(-1, 3)
            yield pd.DataFrame({"id": f["id"], "weight": m[:, 0], "root": m[:, 1], "dense": m[:, 2], "score": 1 / (1 + np.exp(-np.clip(m @ c[:3] + c[3], -30, 30)))})

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(scored, f"id {kind}, weight double, root double, dense double, score double")


def toxicity_scores(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 3,
    held_fold: int = 1,
    threshold: float = 0.7,
    sample: int = 40_000,
    exceptions: tuple[str, ...] = (),
    most_words: int = 20_000,
    most_phrases: int = 20_000,
) -> DataFrame:
    """One row for each row of df: id, held_out, score (0 to 1), predicted (1 where score >= threshold), weight.

    Whole texts are folded (lower case, homoglyphs, digits and signs for letters). Words with a significant share of
    toxic texts make the lexicon, weighted by log odds; exceptions (given ones and those learned) are phrases in which
    they don't count. A logistic curve over the weight, summed and by length, gives the score. Rows whose crc32(id as
    text) mod folds is held_fold never train. Training reads a hashed sample of about so many labelled rows as sample
    says. Of more than most_words significant words or most_phrases learned exceptions, which every task holds, those
    with the highest ratio or count make the lexicon.

    Null and empty texts have no hits and the lowest score. Labels other than 0 and 1 and null ids train nothing; with
    no toxic label the lexicon is empty and all scores are equal. Rows that repeat an id are scored one by one. Other
    columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held_fold, F.lit(False))
    marks = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held & F.col(id_col).isNotNull()).withColumnRenamed(id_col, "id")
    part = min(1.0, sample / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 20)) < part * (1 << 20))
    with temporary():
        # the sampled labels are bounded, so they go to the texts
        train = stash(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "id").select("text", "y"), "toxic")
        n = {r.y: r["count"] for r in train.groupBy("y").count().collect()}

        words = learn_words(train, n.get(1, 0), n.get(0, 0), most_words=most_words)
        spared = tuple(" ".join(folded(p)) for p in exceptions) + (learn_exceptions(train, words, most_phrases) if words else ())
        lexicon = Lexicon(words, spared)
        if words:
            m = score_texts(train.withColumnRenamed("y", "id"), lexicon, "id").select("id", "weight", "root", "dense").toPandas()
            lexicon = Lexicon(words, spared, fit_curve(m[["weight", "root", "dense"]].to_numpy(), m["id"].to_numpy()))
        else:
            lexicon = Lexicon(words, spared, (0.0, 0.0, 0.0, -3.0))
    out = score_texts(df, lexicon, id_col, text_col).withColumnRenamed("id", id_col)
    return out.select(F.col(id_col).cast(kind).alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "weight")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

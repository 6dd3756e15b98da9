"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import sliced, stash, temporary

#: Letters share so many codes (0: between words); letters beyond them share by their code point.
CODES = 256
MOST_LANGUAGES = 10_000


def _letter_codes() -> np.ndarray:
    """Code of each code point of the basic plane: 0 for what is no letter, the same for upper and lower case."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = 1 + low % (CODES - 1)
    return out


class Profiles:
    """Random letter vectors; an n-gram's vector is the product (binding) of its letters' vectors, each permuted by
    its place; a text's vector is the sum (bundle) of its n-grams' vectors."""

    def __init__(self, size: int = 1024, n: int = 3, seed: int = 3) -> None:
        self.size, self.n = size, n
        rng = np.random.default_rng(seed)
        letters = rng.integers(0, 2, (CODES, size), np.int8) * 2 - 1
        turn = rng.permutation(size)
        self.placed = [letters]
        for _ in range(n - 1):
            self.placed.append(self.placed[-1][:, turn])
        self.codes = _letter_codes()

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams (packed codes) with their counts; runs of other characters are one space. None if no letter."""
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) and points.max() >= 1 << 16:
            points = np.where(points < 1 << 16, points, np.where([chr(p).isalpha() for p in points], 0x4E00 + points % 5000, 32))
        c = self.codes[points]
        c = np.concatenate([[0], c, [0]]).astype(np.uint32)
        c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])]
        if len(c) < 3:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        c = np.concatenate([c, np.zeros(max(0, self.n - len(c)), np.uint32)])
        packed = np.zeros(len(c) - self.n + 1, np.uint32)
        for i in range(self.n):
            packed = packed << np.uint32(8) | c[i : len(c) - self.n + 1 + i]
        return np.unique(packed, return_counts=True)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.size, np.float32)
        for i in range(0, len(grams), 4096):
            g = grams[i : i + 4096]
            bound = self.placed[0][g & np.uint32(255)].copy()
            for k in range(1, self.n):
                bound *= self.placed[k][g >> np.uint32(8 * k) & np.uint32(255)]
            total += counts[i : i + 4096].astype(np.float32) @ bound.astype(np.float32)
        return total


def identify_language(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2, size: int = 1024, n: int = 3
) -> DataFrame:
    """One row for each row of df: id, held_out, lang_pred, score (cosine with that language's prototype, 0 to 1).

    A language's prototype is the sum of the profiles of all whole texts that train it: each task sums its own, and
    Spark adds them by language and dimension. Rows whose crc32(id as text) mod folds is held_fold never train, nor
    do rows without language. Prediction reads the text only.

    Null texts and those without a letter are und with score 0, as is every text if no language was learned. Ties
    go to the first language in code point order. Rows that repeat an id are judged one by one. Other columns are
    not read. The driver holds one vector for each language, and refuses over MOST_LANGUAGES.
    """
    kind = df.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held_fold, F.lit(False))

    def learned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, sums = Profiles(size, n), {}
        counts: dict[str, dict[int, int]] = {}

        def settle(lang: str) -> None:
            own = counts.pop(lang)
            g = np.fromiter(own.keys(), np.uint32, len(own))
            sums[lang] = sums.get(lang, 0.0) + p.bundle(g, np.fromiter(own.values(), np.int64, len(own))).astype(np.float64)

        for f in sliced(frames, "text"):
            for lang, own in f.groupby("lang")["text"]:
                both = [p.grams(t) for t in own]
                g, c = np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])
                u, inverse = np.unique(g, return_inverse=True)
                into = counts.setdefault(lang, {})
                for k, v in zip(u.tolist(), np.bincount(inverse, c, len(u)).astype(np.int64).tolist(), strict=True):
                    into[k] = into.get(k, 0) + v
                if len(into) > 200_000:
                    settle(lang)
        for lang in list(counts):
            settle(lang)
        yield pd.DataFrame({"lang": pd.Series(list(sums), dtype=object), "v": pd.Series(list(sums.values()), dtype=object)})

    train = df.where(F.col(lang_col).isNotNull() & ~held & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    parts = train.mapInPandas(learned, "lang string, v array<double>").select("lang", F.posexplode("v").alias("at", "x"))
    summed = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    with temporary():
        rows = sorted(stash(summed, "prototypes").limit(MOST_LANGUAGES + 1).collect(), key=lambda r: r.lang.encode())
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = [r.lang for r in rows]
    prototypes = np.array([r.v for r in rows]).reshape(len(rows), size)
    prototypes = (prototypes / np.maximum(1e-12, np.linalg.norm(prototypes, axis=1, keepdims=True))).astype(np.float32)

    def predicted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Profiles(size, n)
        for f in frames:
            best, score = [], []
            for t in f["text"]:
                g, c = p.grams(t)
                if not len(g) or not langs:
                    best.append("und")
                    score.append(0.0)
                    continue
                v = p.bundle(g, c)
                cos = prototypes @ v / max(1e-12, float(np.linalg.norm(v)))
                i = int(cos.argmax())
                best.append(langs[i])
                score.append(float(min(1.0, max(0.0, cos[i]))))
            yield pd.DataFrame({"id": f["id"], "lang_pred": pd.Series(best, dtype=object), "score": score})

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(predicted, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, held.alias("held_out"), "lang_pred", "score")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_language(spark.read.parquet(f"{sf_dir}/documents.parquet"))

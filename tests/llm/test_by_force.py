"""Whole predictions of the classifiers against plain loops over all texts, grams, words and pairs."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from wattloom.llm.langid import Profiles, identify_language
from wattloom.llm.quality import bradley_terry, features, quality_scores
from wattloom.llm.toxicity import Lexicon, fit_curve, folded, toxicity_scores

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
crc = lambda i, n: zlib.crc32(str(i).encode()) % n


def table(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(3)


def test_language_predictions(spark):
    rng = random.Random(1)
    letters = {"aa": "abcdeé", "bb": "defghß", "cc": "жзиклм", None: "abжз"}
    langs = [rng.choice(list(letters)) for _ in range(150)]
    texts = [" ".join("".join(rng.choices(letters[x], k=rng.randint(1, 6))) for _ in range(rng.randint(1, 9))) for x in langs]
    texts[5:9], langs[9] = [None, "", "12 %", "ABC-abc"], None
    p = Profiles(256)

    def vector(text):
        words, run = [], ""
        for c in (text or "") + " ":
            if c.isalpha():
                run += c.lower()
            elif run:
                words.append(run)
                run = ""
        if not words:
            return None
        codes = [0]
        for w in words:
            codes += [int(p.codes[ord(c)]) for c in w] + [0]
        v = np.zeros(256)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            # the first letter is turned twice, the last not at all
            v += p.placed[2][a].astype(float) * p.placed[1][b] * p.placed[0][c]
        return v

    sums = {}
    for i, (t, x) in enumerate(zip(texts, langs)):
        v = vector(t)
        if x is not None and crc(i, 4) != 2 and v is not None:
            sums[x] = sums.get(x, 0) + v
    got = {r.doc_id: r for r in identify_language(table(spark, texts, langs), size=256).collect()}
    for i, t in enumerate(texts):
        v = vector(t)
        if v is None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cos = {x: float(s @ v / np.linalg.norm(s) / max(1e-12, np.linalg.norm(v))) for x, s in sorted(sums.items())}
        best = max(cos, key=cos.get)
        assert got[i].score == pytest.approx(min(1.0, max(0.0, cos[best])), abs=1e-4) and got[i].held_out == (crc(i, 4) == 2)
        if sorted(cos.values())[-1] - sorted(cos.values())[-2] > 1e-4:
            assert got[i].lang_pred == best


def test_toxicity_scores(spark):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(600):
        w = rng.choices(plain, k=rng.randint(5, 40))
        y = int(rng.random() < 0.3)
        if y:
            w[rng.randrange(len(w))] = rng.choice(["nasty", "N4STY", "vile"])
        elif rng.random() < 0.03:
            at = rng.randrange(len(w))
            w[at : at + 1] = ["vile", "weather"]
        texts.append(" ".join(w))
        labels.append(y)
    texts += [None, ""]
    labels += [0, 1]
    train = [(folded(t), y) for i, (t, y) in enumerate(zip(texts, labels)) if crc(i, 3) != 1]
    n = Counter(y for _, y in train)
    have = {y: Counter(w for t, z in train if z == y for w in set(t)) for y in (0, 1)}
    weights = {}
    for w in have[1]:
        a, b = have[1][w], have[0][w]
        share = (a + b) / (n[0] + n[1])
        cells = [(a, n[1] * share), (b, n[0] * share), (n[1] - a, n[1] * (1 - share)), (n[0] - b, n[0] * (1 - share))]
        ratio = 2 * sum(s * math.log(s / e) for s, e in cells if s > 0)
        odds = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
        if a >= 3 and ratio >= 24 and odds >= 2:
            weights[w] = odds
    pairs = {y: Counter(x for t, z in train if z == y for x in {f"{u} {v}" for u, v in zip(t, t[1:]) if u in weights or v in weights}) for y in (0, 1)}
    spared = {x for x, c in pairs[0].items() if c >= 3 and not pairs[1][x]}

    def measured(words):
        total = 0.0
        for i, w in enumerate(words):
            around = {" ".join(words[i - 1 : i + 1]) if i else "", " ".join(words[i : i + 2])}
            if w in weights and not around & spared:
                total += weights[w]
        return total, total**0.5, 100 * total / len(words) if words else 0.0

    x = np.array([measured(t) for t, _ in train])
    curve = fit_curve(x, np.array([y for _, y in train]))
    rows = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(table(spark, texts), rows).collect()}
    assert weights and spared
    for i, t in enumerate(texts):
        m = measured(folded(t))
        score = 1 / (1 + math.exp(-np.clip(np.dot(m, curve[:3]) + curve[3], -30, 30)))
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].predicted == int(got[i].score >= 0.7), i


def test_quality_scores(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["good", "words", "here", "and", "there."], k=20)) if i % 3 else " ".join(rng.choices(["$$", "x", "#1", "zz zz"], k=20)) for i in range(300)] + [None, ""]
    labels = [int(i % 3 != 0) for i in range(300)] + [0, 1]
    rows = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_scores(table(spark, texts), rows).collect()}
    at = [i for i in range(len(texts)) if crc(i, 5) != 0]
    x, y = np.array([features(t) for t in texts]), np.array(labels)
    mean, scale = x[at].mean(axis=0), x[at].std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = z[[i for i in at if y[i]]], z[[i for i in at if not y[i]]]
    # all pairs, plain gradient steps
    d = (good[:, None, :] - bad[None, :, :]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(2000):
        w += 0.1 * (d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30)))) / len(d) - 1e-2 * w)
    own = bradley_terry(good, bad)
    assert own @ w / np.linalg.norm(own) / np.linalg.norm(w) > 0.999
    raw = np.sort(z[at] @ own)
    k = int((y[at] == 0).sum())
    cut = (raw[k - 1] + raw[k]) / 2
    order = np.argsort([got[i].score for i in range(len(texts))])
    assert (np.diff((z @ own)[order]) >= -1e-6).all()
    for i in range(len(texts)):
        if abs(z[i] @ own - cut) > 1e-3:
            assert got[i].predicted == int(z[i] @ own > cut) and got[i].held_out == (crc(i, 5) == 0)

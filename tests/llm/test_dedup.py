"""Duplicate detectors against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm.common import connected_components, whole_groups
from wattloom.llm.embedding_dedup import embedding_duplicates
from wattloom.llm.exact_dedup import exact_dedup
from wattloom.llm import line_dedup
from wattloom.llm.line_dedup import dedup_lines
from wattloom.llm.minhash import estimated, near_duplicates, registers
from wattloom.llm.common import shingles, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def clashing(df):
    """df with columns that operators use as names of their own."""
    return df.withColumns({n: F.lit("x") for n in ("id", "n", "k", "key", "size", "h0", "cid", "hub", "component", "recipe", "y", "x", "block", "doc", "line", "kept", "score", "_lines", "_n", "_t", "lines", "gone", "left", "_gone", "_doc")})


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = rng.choices(vocab, k=rng.choice([1, 2, 3, 8, 30, 60, 200]))
        out.append(" ".join(w))
    return out + [None, "", "  \n\t", "One two three", "one TWO three", "x" * 5000, "É é", "é é"]


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(40)] + [(300, i) for i in range(301, 360)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(400, links)
    assert got == {n: want[n] for n in {x for ab in links for x in ab} - {5}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_groups_cross_batches():
    import pandas as pd

    f = pd.DataFrame({"k": [1, 1, 2, 3, 3, 3, 4], "v": range(7)})
    got = [g["v"].tolist() for g in whole_groups([f[:2], f[2:5], f[5:5], f[5:]], ["k"])]
    assert got == [[0, 1], [2], [3, 4, 5], [6]]


# --- exact -------------------------------------------------------------------------------------------------------------


def test_exact_dedup(spark):
    base = corpus(1, 20)
    long = " ".join(f"word{i}" for i in range(9000))
    texts = base + [base[0].upper(), base[3].replace(" ", "\n"), base[3] + "  ", long, long.replace(" ", "  "), long[:-1], None, " "] + [base[5]] * 30
    got = {r.doc_id: r for r in exact_dedup(clashing(frame(spark, texts))).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    assert len(got) == len(texts)


def test_exact_dedup_odd_tables(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    rows = exact_dedup(frame(spark, ["a", "a", "a"], [7, 7, None])).collect()
    assert [(r.keep_id, r.group_size) for r in rows] == [(7, 3)] * 3 and sum(r.kept for r in rows) == 2


# --- near --------------------------------------------------------------------------------------------------------------


def sets_of(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    texts = corpus(words)
    s = sets_of(texts, words)
    links = [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    want = roots(len(s), links)
    got = {r.doc_id: r for r in near_duplicates(clashing(frame(spark, texts)), words=words).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(x) for i, x in enumerate(s)}
    assert {i: r.component_id for i, r in got.items()} == dict(enumerate(want))
    assert {i for i, r in got.items() if r.kept} == {i for i, r in enumerate(want) if i == r}


def test_links_that_the_hub_lacks(spark):
    """A chain: the first and the last text aren't similar, those between are; and a crowd around one text."""
    w = [f"c{i}" for i in range(60)]
    chain = [" ".join(w[i : i + 40]) for i in range(0, 20, 2)]
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    crowd = []
    for _ in range(150):
        x = list(base)
        for _ in range(rng.randint(0, 12)):
            x[rng.randrange(100)] = f"z{rng.random()}"
        crowd.append(" ".join(x))
    texts = crowd[:70] + chain + crowd[70:]
    s = sets_of(texts, 2)
    want = roots(len(s), [(a, b) for a in range(len(s)) for b in range(a) if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])])
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, texts), words=2).collect()}
    assert got == dict(enumerate(want))


def test_near_duplicates_odd_tables(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    rows = near_duplicates(frame(spark, ["a b c d e f", "a b c d e f", None], [4, None, None])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == [(4, 4)]
    assert all(r.kept for r in rows)
    twice = near_duplicates(frame(spark, ["a b c d e f"] * 3, [4, 4, 5])).collect()
    assert [r.component_id for r in twice] == [4, 4, 4]


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    for n in (6, 40, 5000):
        union = np.unique(rng.integers(0, 2**63, int(n * 1.1), dtype=np.uint64))
        cut = len(union) // 10
        a, b = np.sort(union[:-cut or None]), np.sort(union[cut:])
        true = (len(union) - 2 * cut) / len(union)
        e = estimated(registers(a)[None], registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(e - true) < 0.2


def test_shingles_are_sets():
    h = word_hashes("a b a b a b")
    assert len(shingles(h, 2)) == 2 and len(shingles(h, 9)) == 1 and len(shingles(word_hashes(None), 2)) == 0


def test_ids_must_be_integers(spark):
    df = frame(spark, ["a b c"]).withColumn("doc_id", F.col("doc_id").cast("string"))
    for f in (near_duplicates, dedup_lines):
        with pytest.raises(TypeError, match="integers"):
            f(df)


# --- embeddings ---------------------------------------------------------------------------------------------------------


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(1)
    rows = []
    for label in (1, 2):
        centres = rng.standard_normal((6, 16))
        for i in range(260):
            c = centres[i % 6] if i < 200 else rng.standard_normal(16)
            rows.append([(c + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist(), label])
    rows += [[rows[0][0], 1]] * 40 + [[rows[0][0], 2], [rows[0][0], None], [None, 1], [[0.0] * 16, 1], [[float("nan")] + [1.0] * 15, 1], [[None] + [1.0] * 15, 1], [[1.0, 2.0], 1], [[2.0, 4.0], 1], [[], 1]]
    df = spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    links = []
    u = [None if v is None or y is None or not v or any(x is None or x != x for x in v) or not any(v) else np.array(v, float) / np.linalg.norm(np.array(v, float)) for v, y in rows]
    for a in range(len(rows)):
        for b in range(a):
            if u[a] is not None and u[b] is not None and rows[a][1] == rows[b][1] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.93:
                links.append((a, b))
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    want = roots(len(rows), links)
    got = {r.vec_id: r for r in embedding_duplicates(clashing(df), windows=(16,)).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: n[i] for i in range(len(rows))}
    assert {i: r.component_id for i, r in got.items()} == dict(enumerate(want))


def test_embedding_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_duplicates(empty).count() == 0


# --- lines --------------------------------------------------------------------------------------------------------------


def line_tokens(line, words=1):
    w = line.encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def lines_by_force(texts, words=1, threshold=0.8, least=1):
    seen, out = [], {}
    for i, t in enumerate(texts):
        gone = []
        for n, line in enumerate(t.split("\n") if t is not None else []):
            s = line_tokens(line, words)
            if len(line.encode().split()) < least:
                continue
            if any(len(s & o) >= threshold * len(s | o) - 1e-9 for o in seen):
                gone.append(n)
            seen.append(s)
        out[i] = gone
    return out


@pytest.mark.parametrize(("few", "words"), [(16, 1), (1, 1), (16, 5)])
def test_line_dedup(spark, monkeypatch, few, words):
    monkeypatch.setattr(line_dedup, "FEW", few)
    if few == 1:  # crowds in many blocks, more bits for all but short lines
        monkeypatch.setattr(line_dedup, "BLOCK", 3)
        monkeypatch.setattr(line_dedup, "LONG", 8)
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    pool = [" ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 6, 12, 30, 80]))) for _ in range(30)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(pool).split() if rng.random() < 0.7 else rng.choices(vocab, k=rng.choice([2, 10, 40]))
            if len(w) > 9 and rng.random() < 0.5:
                w = list(w)
                w[rng.randrange(len(w))] = rng.choice(vocab)
            lines.append(" ".join(w))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", texts[0], texts[0].upper(), "a b c d e f\na b c d e f\n"]
    gone = lines_by_force(texts, words)
    got = {r.doc_id: r for r in dedup_lines(clashing(frame(spark, texts)), words=words).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        keep = None if t is None else [x for n, x in enumerate(t.split("\n")) if n not in gone[i]]
        assert got[i].text == (None if t is None else "\n".join(keep)), i
        assert (got[i].n_removed, got[i].kept) == (len(gone[i]), not gone[i] or len(keep) > 0)
    assert sum(map(len, gone.values())) > 20


def test_line_dedup_odd_tables(spark):
    assert dedup_lines(frame(spark, [])).count() == 0
    rows = dedup_lines(frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [None, 3, 4])).collect()
    assert {(r.doc_id, r.kept) for r in rows} == {(None, True), (3, True), (4, False)}
    assert {"lang", "source", "n_chars"} <= set(rows[0].asDict())

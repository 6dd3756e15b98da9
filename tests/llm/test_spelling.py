"""Spelling variants against all pairs of words, with odd texts and tables."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wattloom.llm.common import temporary
from wattloom.llm.spelling import op12_spelling_variants, spelling_variants, trie_nodes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(3)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, least=6, occurrences=5, every=199):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= occurrences}


def brute(rows, ratio=5, near=None, **limits):
    n = counted(rows, **limits)
    near = {w: [v for v in n if one_edit(w, v)] for w in n} if near is None else near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def by_deletions(n):
    """Near words of each word by its letters deleted or replaced, one by one."""
    letters = sorted({c for w in n for c in w})
    out = {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            for v in {w[:i] + w[i + 1 :], *(w[:i] + c + w[i + 1 :] for c in letters)}:
                if v in n and v != w:
                    out[w].add(v)
                    out[v].add(w)
    return out


def rows_of(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def corpus(seed=0):
    """Texts of a few letters, so that words are near, with runs of equal letters and counts that are far apart."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("aabcÀé", k=rng.randint(5, 9))) for _ in range(60)]
    base += [b[:i] + c + b[i:] for b in base[:40] for i, c in [(rng.randrange(len(b)), rng.choice("abcé"))]]
    base += [b[:i] + b[i + 1 :] for b in base for i in [rng.randrange(len(b))]]
    weights = [5 ** rng.randint(0, 4) for _ in base]
    return [rng.choice([" ", "-", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(base, weights, k=rng.randint(0, 400))) for _ in range(150)]


@pytest.mark.parametrize("seed", [0, 1])
def test_variants_are_those_of_all_pairs(spark, seed):
    texts = corpus(seed)
    texts[3:7] = [None, "", "12 中文 !", texts[0]]  # no words, and a repeated text
    ids = [i if i % 50 else None for i in range(len(texts))]
    ids[9] = ids[8]
    want = brute(list(zip(ids, texts)))
    df = table(spark, texts, ids).withColumns({c: F.lit("x") for c in ("id", "word", "n", "k", "p", "s", "m", "form", "root", "nodes", "part", "nth", "heads")})
    assert len(want) > 60 and any(r[1] for r in want) and any(r[1] != r[2] for r in want if r[1])
    assert rows_of(spelling_variants(df)) == want


def test_ties_and_chains(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdxg": 125, "abcyxg": 125, "zbcdef": 5, "zbbdef": 5, "aaaaaa": 5, "aaaaaaa": 25, "aaaaab": 25}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    want = brute([(None, text)], every=10**9)
    assert rows_of(spelling_variants(table(spark, [text], [None]), every=10**9)) == want
    got = {r[0]: r for r in want}
    assert got["abcdef"][1:3] == ("abcdeg", "abcdxg") and got["aaaaaa"][1] == "aaaaaaa" and got["zbcdef"][1] is None and got["zbcdef"][4] == 2


def test_long_words_and_empty_tables(spark):
    long = "ab" * 3000
    df = table(spark, [f"{long} {long[:-1]} {long}c "] * 30 + [f"{long} " * 900] + ["q" * 300_000] * 5)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert rows_of(spelling_variants(df)) == brute(rows)
    for empty in (table(spark, []), table(spark, [None, "", "1 2"])):
        got = spelling_variants(empty)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


def test_nodes_are_shared_over_tasks(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(900)} | {"a" * k for k in range(1, 60)})
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with temporary():
            rows = trie_nodes(spark.createDataFrame([(w,) for w in words], "word string"), "word").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.enabled", was[1])
    assert len({r.part for r in rows}) > 20
    node = {}
    for r in rows:
        assert len(r.nodes) == len(r.word)
        for i, x in enumerate(r.nodes):
            assert node.setdefault(r.word[: i + 1], x) == x
    assert len(set(node.values())) == len(node)
    assert [r.word for r in sorted(rows, key=lambda r: (r.part, r.nth))] == words


def test_query_on_given_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert rows_of(op12_spelling_variants(spark, "/root/testdata/sf0.01")) == brute(rows, near=by_deletions)

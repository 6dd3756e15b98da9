"""Classifiers, mixing, URL filters and segmentation: brute force, held-out accuracy, exact round trips, odd tables."""

import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm.langid import Profiles, identify_language
from wattloom.llm.mixing import mix, mixed_documents, shard_quotas, splitting_tree, targets
from wattloom.llm.quality import bradley_terry, quality_scores
from wattloom.llm.sentencepiece_sampling import Lattice, decode_pieces, decoded, default_model, encode_samples, sample_segmentations, vocabulary
from wattloom.llm.toxicity import Lexicon, folded, measures, toxicity_scores
from wattloom.llm.url_filter import blocked_bloom, possible_hits, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, langs=None, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("x") for n in ("id", "y", "x", "k", "score", "size", "block", "held_out")})


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


# --- mixing -------------------------------------------------------------------------------------------------------------


def test_targets_by_hand():
    assert targets(np.array([100.0, 100.0, 100.0]), np.array([5.0, 2.0, 1.0])).tolist() == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert targets(np.array([0.0, 10.0]), np.array([5.0, 2.0])).tolist() == [0.0, 15.0]
    assert targets(np.array([]), np.array([])).tolist() == []


def test_splitting_tree_is_exact(spark):
    quotas = np.array([70, 0, 13, 1])
    tree = np.zeros((7, 4), int)
    for lo, hi, nth, left in splitting_tree(0, 7, np.arange(4), quotas, 3):
        assert hi == lo + 1
        tree[lo, nth] = left
    assert tree.sum(axis=0).tolist() == quotas.tolist() and set(tree.sum(axis=1)) <= {12, 13}
    rows = spark.createDataFrame([(i, int(q)) for i, q in enumerate(quotas)], "nth long, units long")
    again = np.zeros((7, 4), int)
    for r in shard_quotas(rows, 7, 3).collect():
        again[r.shard, r.nth] += r.units
    assert (tree == again).all()


def test_many_sources_and_shards(spark):
    """20,000 sources among 3,000 shards, of which no table of all pairs is made."""
    rows = spark.range(20_000).select(F.col("id").alias("nth"), (F.col("id") % 5).alias("units"))
    out = shard_quotas(rows, 3000, 1)
    by_shard = [r.n for r in out.groupBy("shard").agg(F.sum("units").alias("n")).collect()]
    assert len(by_shard) == 3000 and max(by_shard) - min(by_shard) <= 1
    wrong = out.groupBy("nth").agg(F.sum("units").alias("n")).join(rows, "nth", "full").where("coalesce(n, 0) <> units")
    assert out.agg(F.min("units")).first()[0] > 0 and wrong.count() == 0


def test_mixed_documents_with_clashing_names(spark):
    df = frame(spark, ["a b", "c"]).withColumns({n: F.lit("x") for n in ("_source", "_block", "_shard", "_shards", "shards", "copy", "SHARD", "target", "block")})
    out = mixed_documents(df)
    assert out.columns == df.columns and {r.shards for r in out.collect()} == {"x"}


def test_mix(spark):
    rng = random.Random(0)
    sources = ["b", "a", "c", None, "Z", "é"]
    texts = [" ".join(["w"] * rng.randint(0, 30)) for _ in range(1200)]
    own = [rng.choice(sources) for _ in texts]
    df = frame(spark, texts, sources=own)
    rows = mix(df, shard_words=2000).collect()
    size = defaultdict(int)
    for t, s in zip(texts, own, strict=True):
        size[s] += len(t.split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, targets(np.array([size[s] for s in order], float), np.resize([5.0, 2.0, 1.0], len(order))), strict=True))
    taken = defaultdict(int)
    for r in rows:
        s = own[r.doc_id]
        assert (r["size"], r.source_size, r.target, r.taken) == (len(texts[r.doc_id].split()), size[s], pytest.approx(goal[s]), len(r.shards) * r["size"])
        assert r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= max(31, 0.01 * goal[s]) for s in goal)
    assert sorted(map(str, rows)) == sorted(map(str, mix(df, shard_words=2000).collect()))
    mixed = mixed_documents(df, shard_words=2000)
    assert mixed.columns == df.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert times == Counter({r.doc_id: len(r.shards) for r in rows if r.shards})


def test_mix_odd_tables(spark):
    assert mix(frame(spark, [])).count() == 0 and mixed_documents(frame(spark, [])).count() == 0
    rows = mix(frame(spark, [None, "", "a b"], ids=[None, 1, 1])).collect()
    assert sorted(r["size"] for r in rows) == [0, 0, 2]


# --- quality ------------------------------------------------------------------------------------------------------------


def prose(rng, n=None):
    return " ".join(rng.choices([f"word{i}" for i in range(200)], k=n or rng.randint(20, 80))) + "."


def test_quality_on_held_out_rows(spark):
    rng = random.Random(1)
    texts, y = [], []
    for i in range(400):
        bad = rng.random() < 0.25
        t = prose(rng)
        texts.append(rng.choice([t.replace(" ", "### "), "| ".join(t.split()), "spam " * 50]) if bad else t)
        y.append(0 if bad else 1)
    texts += [None, "", " ", "x" * 20000]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)] + [(None, 1, 0), (1, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_scores(df, labels).collect()}
    assert len(got) == len(texts)
    assert all(r.held_out == (crc(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == y[i] for i in held) / len(held) > 0.95


def test_quality_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_scores(frame(spark, []), none).count() == 0
    assert len({r.score for r in quality_scores(frame(spark, ["a", "b c"]), none).collect()}) == 1
    assert bradley_terry(np.ones((3, 2)), np.zeros((0, 2))).tolist() == [0.0, 0.0]


# --- toxicity -----------------------------------------------------------------------------------------------------------


def test_folding():
    assert folded("You IDI0T, 1d10t! $cum$$$ іdіоt id​iot a.b") == ["you", "idiot", "idiot", "scum", "idiot", "idiot", "a", "b"]
    assert folded(None) == [] == folded("...")


def test_exception_phrases():
    lexicon = Lexicon({"trash": 4.0}, ("trash can",))
    a = lexicon.automaton()
    assert measures("trash trash can trashy", a)[0] == 4.0
    assert measures("Tr4sh", a)[0] == 4.0 and measures("clean", a) == (0.0, 0.0, 0.0)
    assert measures("anything", Lexicon({}).automaton()) == (0.0, 0.0, 0.0)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    bad = ["moron", "scum", "loser"]
    texts, y = [], []
    for i in range(400):
        w = prose(rng).split()
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        y.append(int(toxic))
    texts += ["you m0r0n, scum! l0ser morоn", "all is well here today", None, "", "x y " * 9000]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(df, labels).collect()}
    assert len(got) == len(texts)
    assert all(r.held_out == (crc(i, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    held = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == y[i] for i in held) / len(held) > 0.97
    assert got[400].predicted == 1 and [got[i].predicted for i in range(401, 405)] == [0] * 4


def test_toxicity_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity_scores(frame(spark, []), none).count() == 0
    assert {r.predicted for r in toxicity_scores(frame(spark, ["a", None]), none).collect()} == {0}


# --- languages ----------------------------------------------------------------------------------------------------------


def test_profiles_are_linear_and_bound():
    p = Profiles(size=4096, n=3)
    a, b = p.grams("hello"), p.grams("HELLO!")
    assert (a[0] == b[0]).all()  # case and signs don't count
    v = p.bundle(*a)
    by_hand = np.zeros(4096)
    for g, c in zip(*a, strict=True):
        x = [g >> 16 & 255, g >> 8 & 255, g & 255]
        by_hand += c * p.placed[2][x[0]].astype(int) * p.placed[1][x[1]] * p.placed[0][x[2]]
    assert np.allclose(v, by_hand)
    w = p.bundle(*p.grams("olleh"))
    assert abs(v @ w) / np.linalg.norm(v) / np.linalg.norm(w) < 0.2  # order matters
    assert len(p.grams("12 .")[0]) == 0 and len(p.grams("é")[0]) == 1 and len(p.grams("𝒳y")[0]) > 0


def test_language_on_held_out_rows(spark):
    rng = random.Random(3)
    parts = {"a": ["the", "ing", "tion", "er"], "b": ["sch", "ung", "keit", "ß"], "c": ["eau", "tré", "çon", "oui"]}
    langs = [rng.choice(list(parts)) for _ in range(300)]
    texts = [" ".join("".join(rng.choices(parts[x], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 40))) for x in langs]
    texts += [None, "", "123 ...", "the " * 9000]
    df = frame(spark, texts, langs=[*langs, "a", "a", "a", None])
    got = {r.doc_id: r for r in identify_language(df, size=256).collect()}
    assert len(got) == len(texts) and all(r.held_out == (crc(i, 4) == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i in range(300) if got[i].held_out]
    assert sum(got[i].lang_pred == langs[i] for i in held) / len(held) > 0.97
    assert [got[i].lang_pred for i in range(300, 304)] == ["und"] * 3 + ["a"]


def test_language_odd_tables(spark):
    assert identify_language(frame(spark, [])).count() == 0
    assert [r.lang_pred for r in identify_language(frame(spark, ["abc"], langs=[None])).collect()] == ["und"]


# --- URLs ---------------------------------------------------------------------------------------------------------------


def test_url_rules_and_list(spark):
    urls = [
        "http://a.example.org/es/1", "http://example.org/en/17?x", "http://EXAMPLE.org/xx", "https://b.com/fr/1", "https://b.com/de/", "https://notcom/de/", "http://x.net/p/", "http://www.x.net/p#t", "http://x.net/q",
        None, "no scheme", "://", "http://", "http://x.org", "ftp://com/fr/", "http://c.com?q=/fr/", "http://x.net/p",
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumns({n: F.lit("x") for n in ("id", "host", "rule", "k", "canon")})
    listed = spark.createDataFrame([("https://x.net/p",), ("HTTP://com/de/",), (None,), ("",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(df, listed).collect()}
    assert got == {
        0: ("a.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/17", "example.org/en/1", "block"), 2: ("example.org", "/xx", "org/", "allow"),
        3: ("b.com", "/fr/1", "com/fr/", "allow"), 4: ("b.com", "/de/", "com/de/", "block"), 5: ("notcom", "/de/", None, "allow"), 6: ("x.net", "/p/", None, "block"), 7: ("www.x.net", "/p", None, "block"),
        8: ("x.net", "/q", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("", "", None, "allow"), 12: ("", "", None, "allow"), 13: ("x.org", "", None, "allow"),
        14: ("com", "/fr/", "com/fr/", "allow"), 15: ("c.com", "", None, "allow"), 16: ("x.net", "/p", None, "block"),
    }
    assert url_filter(df.limit(0), listed).count() == 0 and url_filter(df, listed.limit(0)).where("listed").count() == 0


def test_bloom_has_no_false_negatives(spark):
    names = spark.range(3000).select(F.concat(F.lit("h/"), "id").alias("u"))
    bloom, blocks = blocked_bloom(names, "u")
    assert possible_hits(names, "u", bloom, blocks).count() == 3000
    others = spark.range(3000, 13000).select(F.concat(F.lit("h/"), "id").alias("u"))
    assert possible_hits(others, "u", bloom, blocks).count() < 300


# --- segmentation -------------------------------------------------------------------------------------------------------

ODD = ["the cat", "a", "Hello  world\n\tfoo", "  x ", "", "日本Ａ▁", "theater", "\n", " " * 30, "a​b😀", "é" * 50, "x" * 3000, "tail \n"]


def test_samples_decode_and_differ():
    v = vocabulary(default_model())
    rows = list(sample_segmentations(ODD, list(range(len(ODD))), 3, v))
    seen = defaultdict(set)
    for d, j, ids, lp, g, inclusion in rows:
        assert decoded(ids, v) == ODD[d] and lp <= 1e-9 and 0 <= inclusion <= 1
        assert tuple(ids) not in seen[d] and j == len(seen[d])
        seen[d].add(tuple(ids))
    assert len(seen[4]) == 0 and len(seen[1]) >= 1 and len(seen[6]) == 3
    values = [g for d, _, _, _, g, _ in rows if d == 6]
    assert values == sorted(values, reverse=True)
    assert [tuple(r[2]) for r in sample_segmentations([ODD[6]], [6], 3, v)] == [tuple(r[2]) for r in rows if r[0] == 6]  # alone or in a batch


def test_sampling_follows_the_lattice():
    """First samples have the lattice's probabilities; inverse inclusion weights add up to them (Horvitz-Thompson)."""
    v = vocabulary(default_model())
    lattice = Lattice([" the"], v)

    def paths(node, lp):
        if lattice.done[node]:
            yield lp
            return
        for e in range(lattice.first[node], lattice.first[node + 1]):
            yield from paths(lattice.target[e], lp + lattice.logp[e])

    probabilities = sorted((math.exp(x) for x in paths(0, 0.0)), reverse=True)
    assert sum(probabilities) == pytest.approx(1.0)
    n, first, weights = 1500, Counter(), Counter()
    for s in range(n):
        for _, j, ids, lp, _, inclusion in sample_segmentations(["the"], [s * 7919 + 1], 2, v):
            first[tuple(ids)] += j == 0
            weights[tuple(ids)] += math.exp(lp) / inclusion / n
    got = [c / n for _, c in first.most_common(2)]
    assert got == pytest.approx(probabilities[:2], abs=0.04)
    assert sum(weights.values()) == pytest.approx(1.0, abs=0.05)


def test_encode_and_decode_tables(spark):
    df = frame(spark, [*ODD, None])
    out = encode_samples(df, default_model(), k=2)
    rows = out.collect()
    assert all(r.round_trip for r in rows) and {r.doc_id for r in rows} == set(range(len(ODD) + 1))
    back = {(r.doc_id, r.text) for r in decode_pieces(out, default_model()).collect()}
    assert back == {(i, t) for i, t in enumerate([*ODD, None])}
    assert encode_samples(df.limit(0), default_model()).count() == 0


# --- long texts ---------------------------------------------------------------------------------------------------------


def measures_by_force(text, automaton):
    w = folded(text)
    joined = f" {' '.join(w)} "
    found = [(end - n, end, x) for end, (n, x) in automaton.iter(joined)]
    spared = [(a, b) for a, b, x in found if x is None]
    return sum(x for a, b, x in found if x is not None and not any(c <= a and b <= d for c, d in spared))


def test_exceptions_of_long_texts():
    a = Lexicon({"trash": 2.0, "can": 1.0, "bad": 0.5}, ("trash can", "not bad at", "at all")).automaton()
    rng = random.Random(5)
    for _ in range(200):
        t = " ".join(rng.choices(["trash", "can", "not", "bad", "at", "all", "x"], k=30))
        assert measures(t, a)[0] == pytest.approx(measures_by_force(t, a))
    begin = time.process_time()
    assert measures("trash can bad " * 100_000, a)[0] == pytest.approx(50_000)
    assert time.process_time() - begin < 20


def test_unbroken_text_takes_seconds():
    vocab = vocabulary(default_model())
    text = "".join(chr(97 + (i * i * 31 + i) % 26) for i in range(300_000))
    begin = time.process_time()
    rows = list(sample_segmentations([text, "short text", text[:50]], [1, 2, 3], 2, vocab))
    assert time.process_time() - begin < 30
    assert len(rows) == 6 and all(decoded(r[2], vocab) == [text, "short text", text[:50]][r[0]] for r in rows)


def test_units_alone_and_together_agree():
    """Few long units are gone through one by one, many at once, with the same draws."""
    vocab = vocabulary(default_model())
    text = "Unzusammenhängend" * 30
    alone = list(sample_segmentations([text], [7], 2, vocab))
    others = [text[: 400 + 10 * i] for i in range(12)]
    together = [r for r in sample_segmentations([text, *others], [7, *range(100, 112)], 2, vocab) if r[0] == 0]
    assert [r[2].tolist() for r in alone] == [r[2].tolist() for r in together]
    assert [r[3] for r in alone] == pytest.approx([r[3] for r in together])


def test_copies_have_seeds_of_their_own(spark):
    df = spark.createDataFrame([(1, "several words to be cut in pieces", 1), (1, "several words to be cut in pieces", 2)], "doc_id long, text string, copy int")
    plain = {r.perturbed for r in encode_samples(df.limit(1), default_model()).collect()}
    rows = {r.perturbed for r in encode_samples(df, default_model(), copy_col="copy").collect()}
    assert len(plain) == 2 and len(rows) == 4 and plain < rows


def test_workers_keep_no_lattices_between_tasks(spark):
    """Lattices of words belong to a task: a worker that goes on to another stage holds none."""
    df = spark.range(200).selectExpr("id AS doc_id", "concat('word', id, ' common text') AS text").coalesce(1)

    def held(batches):
        import gc

        for b in batches:
            yield b.assign(n=sum(type(o).__name__ == "Known" for o in gc.get_objects()))

    # tasks one after the other in a worker
    for _ in range(4):
        assert encode_samples(df, default_model()).count() == 400
        assert spark.range(8, numPartitions=8).mapInPandas(held, "id long, n long").agg(F.max("n")).first()[0] == 0

"""Licence scans against plain loops over words, places and templates, with odd texts and tables."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from wattloom.llm.license_scan import BASE, NOTICES, op13_license_scan, scan_licenses

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(3)


def split(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def has(words, key):
    return [i for i in range(len(words) - len(key) + 1) if words[i : i + len(key)] == key]


def brute(texts):
    """Every place of every template, word by word."""
    docs = [split(t) for t in texts]
    n = len(docs)
    templates = [(t, split(t.text), [split(k) for k in t.keys]) for t in (*BASE, *NOTICES)]
    weight = {w: math.log1p((n + 1) / (sum(w in set(d) for d in docs) + 0.5)) for _, x, _ in templates for w in x}
    out = []
    for d in docs:
        starts, base, labels, best = [], set(), set(), 0.0
        for t, x, keys in templates:
            total = sum(weight[w] for w in x)
            order = sorted(range(len(x)), key=lambda p: (-round(weight[x[p]], 12), p))
            anchors, had = [], 0.0
            for p in order:
                anchors.append(p)
                had += weight[x[p]]
                if had > (1 - t.need) * total + 1e-9:
                    break
            for o in range(1 - len(x), len(d)):
                if not any(0 <= o + p < len(d) and d[o + p] == x[p] for p in anchors):
                    continue
                near = lambda p: d[max(0, o + p - t.slack) : max(0, o + p + t.slack + 1)]
                share = sum(weight[w] for p, w in enumerate(x) if w in near(p)) / total
                best = max(best, share)
                inside = lambda k: any(o - t.slack <= i and i + len(k) <= o + len(x) + t.slack for i in has(d, k))
                if share >= t.need - 1e-9 and all(inside(k) for k in keys):
                    labels.add(t.label)
                    if t.base:
                        base.add(t.label)
                        starts.append(o)
        assert sorted(starts) == sorted(i for t, x, _ in templates if t.base for i in has(d, x))
        out.append((len(d), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), pytest.approx(min(1.0, best), abs=1e-9)))
    return out


def texts_of(seed=0, n=120):
    rng = random.Random(seed)
    lines = [t.text for t in (*BASE, *NOTICES)]
    filler = ["the", "license", "of", "version", "2", "3", "under", "a", "wort", "ünder", "mit", "software", "x1", "free", "cc", "by", "public"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(lines).split() if rng.random() < 0.4 else rng.choices(filler, k=rng.randint(0, 12))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice([*filler, "more words here", ""])
            parts.append(rng.choice([" ", ", ", "-"]).join(w))
        out.append(rng.choice([" ", "\n", ". "]).join(parts))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_scans_are_those_of_plain_loops(spark, seed):
    texts = [*texts_of(seed), None, "", "¡§ 中文", "Under_the@MIT`license", "CC BY-NC 4.0 cc by nc", "under the mit license " * 300]
    texts.append(texts[0])
    df = table(spark, texts).withColumns({c: F.lit("x") for c in ("id", "n", "word", "labels", "score", "n_words")})
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    want = brute(texts)
    assert len(got) == len(texts) and sum(w[1] > 0 for w in want) > 10 and any(w[5] != w[4] for w in want)
    for i, w in enumerate(want):
        assert tuple(got[i][c] for c in NAMES[1:]) == w


def test_labels_beyond_base_phrases(spark):
    cases = {
        "This work is licensed under the GNU General Public License, version 3.": ("", "gpl-3"),
        "Licensed under the Apache License, Version 2.0.": ("apache-2", "apache-2"),
        "Released under the MIT License.": ("mit", "mit"),
        "Licensed under CC BY-NC 4.0.": ("cc-by-nc", "cc-by-nc"),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and its associated documentation files (the \"Software\"), to deal in the Software without restriction": ("", "mit"),
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": ("", "bsd"),
        # most words, but not the key phrase
        "Redistribution or use as source and binary forms, with or without modification, are permitted provided that the following conditions are met:": ("", ""),
        "the public version of a work in general, 3 words under the sun": ("", ""),
        "the terms of the license": ("", ""),
    }
    filler = [f"der lich und version of the {i}" for i in range(200)]
    got = {r.doc_id: r for r in scan_licenses(table(spark, [*cases, *filler])).collect()}
    for i, (text, (base, labels)) in enumerate(cases.items()):
        assert (got[i].base_labels, got[i].labels) == (base, labels), text
        assert 0 <= got[i].score <= 1
    assert not any(got[len(cases) + i].labels for i in range(200))


def test_odd_tables(spark):
    empty = scan_licenses(table(spark, []))
    assert empty.columns == list(NAMES) and empty.count() == 0
    rows = scan_licenses(table(spark, ["cc by nc", "cc by nc", None], [None, 5, 5])).collect()
    assert sorted((str(r.doc_id), r.n_base) for r in rows) == [("5", 0), ("5", 1), ("None", 1)]
    long = "wort " * 400_000 + "cc-by-nc " + "wort " * 10
    row = scan_licenses(table(spark, [long])).first()
    assert (row.n_words, row.first_word, row.base_labels) == (400_013, 400_000, "cc-by-nc")


def test_query_on_given_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: r for r in op13_license_scan(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r in rows:
        w, g = split(r.text), got[r.doc_id]
        starts = [i for t in BASE for i in has(w, split(t.text))]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
        gpl = "under the GNU General Public License, version 3" in (r.text or "")
        assert set(g.labels.split(",")) - {""} == set(g.base_labels.split(",")) - {""} | ({"gpl-3"} if gpl else set())

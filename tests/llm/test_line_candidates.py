"""The step of line dedup in which lines that share a rare token meet."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from test_dedup import frame, lines_by_force
from wattloom.llm import line_dedup


def test_lines_that_only_share_words_are_not_written(spark, monkeypatch):
    """Lines whose rare words several others have, but of which none is similar, meet where their words are dealt."""
    rng = random.Random(5)
    texts = ["\n".join(" ".join(f"w{rng.randrange(400)}" for _ in range(30)) for _ in range(5)) for _ in range(60)]
    rows, write = [], line_dedup.stash

    def counted(df, name):
        out = write(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stash", counted)
    assert line_dedup.repeated_lines(frame(spark, texts)).count() == 0
    assert sum(rows) < 60  # 2,100 prefix tokens, of which nearly all are shared


@pytest.mark.parametrize("near", [0, 2])
def test_crowds_of_near_copies(spark, monkeypatch, near):
    """The same result where lines with more than near candidates are crowds, others not."""
    monkeypatch.setattr(line_dedup, "NEAR", near)
    rng = random.Random(7)
    pool = [[f"w{rng.randrange(10**4)}" for _ in range(k)] for k in (6, 10, 25, 60, 110, 150)]
    texts = []
    for _ in range(60):
        w = list(rng.choice(pool))
        for _ in range(rng.randrange(1 + len(w) // 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        texts.append(" ".join(w))
    gone = lines_by_force(texts)
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, texts).repartition(5)).collect()}
    assert got == {i: len(g) for i, g in gone.items()}
    assert 0 < sum(map(len, gone.values())) < 60


def test_numbers_by_bytes():
    for kind in (np.int32, np.int64):
        x = np.array([[1, -2, 300], [1 << 30, 0, -(1 << 20)]], kind)
        assert (line_dedup._numbers(b"".join(map(line_dedup._planes, x)), kind, 2) == x).all()
        assert line_dedup._numbers(b"", kind, 2).shape == (2, 0)


def test_counters_never_part_similar_lines():
    """Counters differ by no more than the sets do, also where they run over, and tell most unlike long lines apart."""
    rng = np.random.default_rng(4)
    apart = 0
    for _ in range(200):
        size = int(rng.integers(line_dedup.COUNTED, 250))
        a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        other = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        near = np.concatenate([a[int(rng.integers(0, size // 6)) :], other[: int(rng.integers(0, size // 9))]])
        if len(near) < line_dedup.COUNTED:
            continue
        sums = line_dedup._sums(np.concatenate([a, near, other, a[:9]]), np.array([len(a), len(near), len(other), 9])).view(np.uint64)
        assert sums[3] == 0
        assert line_dedup._apart(sums[:1], sums[1:2])[0] <= len(np.setxor1d(a, near))
        apart += line_dedup._apart(sums[:1], sums[2:3])[0] > (len(a) + len(other)) / 9
    assert apart > 100


def test_texts_of_candidates_are_read_once(spark, monkeypatch):
    """Lines that match their nearest candidate, another one or one of a crowd: all texts come from one reading."""
    rng = random.Random(12)
    base = [[f"w{rng.randrange(5000)}" for _ in range(40)] for _ in range(12)]
    texts = ["\n".join(" ".join(x if rng.random() > 0.08 else f"x{rng.randrange(90)}" for x in rng.choice(base)) for _ in range(3)) for _ in range(60)]
    names, write = [], line_dedup.stash
    monkeypatch.setattr(line_dedup, "stash", lambda df, name: names.append(name) or write(df, name))
    monkeypatch.setattr(line_dedup, "FEW", 4)
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, texts).repartition(5)).collect()}
    assert got == {i: len(g) for i, g in lines_by_force(texts).items()}
    assert names.count("matched") > 1 and names.count("texts") == 1


def test_batches_are_scanned_as_texts_are(monkeypatch):
    texts = ["", "a b\nA  b\n", "\n\n", "é\tü ż\n日本 語", "x" * 50, " ", "last one"]
    batch = pa.record_batch({"text": pa.array(["before", *texts])}).slice(1)
    want = line_dedup.scanned(texts, lines=True)
    for size in (1, 12, 10**6):
        monkeypatch.setattr(line_dedup, "_BYTES", size)
        pieces = [(rows, line_dedup.scanned(x, lines=True)) for rows, x in line_dedup._pieces(batch)]
        assert np.concatenate([rows for rows, _ in pieces]).tolist() == list(range(len(texts)))
        for name in ("word", "line_hash", "no"):
            assert (np.concatenate([getattr(s, name) for _, s in pieces]) == getattr(want, name)).all()
        assert (np.concatenate([rows[s.text] for rows, s in pieces]) == want.text).all()


@pytest.mark.parametrize("words", [1, 3])
def test_similar_pairs_by_one_sort(monkeypatch, words):
    """As sets say, from one sort of packed keys; pairs were sorted twice before."""
    rng = random.Random(2)
    a = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(40))] for _ in range(400)]
    b = [[x if rng.random() > 0.05 else "new" for x in line] for line in a]
    sets = lambda line: {tuple(line[i : i + words]) for i in range(max(1, len(line) - words + 1))} if line else set()
    want = [10 * len(sets(x) & sets(y)) >= 8 * len(sets(x) | sets(y)) for x, y in zip(a, b, strict=True)]
    monkeypatch.setattr(np, "lexsort", None)
    pairs = pd.DataFrame({"t_a": [" ".join(x) for x in a], "t_b": [" ".join(x) for x in b]})
    assert line_dedup._similar(pairs, words, 0.8).tolist() == want and 0 < sum(want) < len(want)

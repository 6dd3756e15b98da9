"""The query and the stage of line dedup on lines of fewer words than a token has."""

import random

import corpus_pipeline
from test_dedup import frame, lines_by_force
from wattloom.llm import line_dedup
from wattloom.llm.line_dedup import op5_line_dedup


def test_short_lines_go_too(spark, tmp_path):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(6)]
    texts = ["\n".join(" ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 3, 4, 7]))) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += ["All rights reserved.", "x\nall rights  RESERVED.", "Les.", "Les.", "", "\n \n", None]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    gone = lines_by_force(texts, least=1)
    keep = [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in op5_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: (r.text, r.n_removed) for i, r in got.items()} == {i: (t, len(gone[i])) for i, t in enumerate(keep)}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert stage == {i: r.text for i, r in got.items() if r.kept}
    assert sum(map(len, gone.values())) > sum(map(len, lines_by_force(texts, least=5).values()))


def test_ranks_follow_counts_at_any_size(spark, monkeypatch):
    """A token that twenty lines have sorts after one that two lines have, and that after one of a single line, in a
    small table and in one of a hundred times as many tokens."""
    rng = random.Random(3)
    often, twice, once = (" ".join(f"{k}{i}" for i in range(5)) for k in "abc")
    for others in (10, 1000):
        texts = ["\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(5)) for _ in range(others)]
        texts += [f"{often} x{i}" for i in range(20)] + [f"{twice} y{i}" for i in range(2)] + [once]
        ranks, total = line_dedup.token_ranks(frame(spark, texts).repartition(5), 5)
        t, line = line_dedup.tokens(line_dedup.scanned([often, twice, once]), 5)
        a, b, c = ranks[line_dedup._counter(t)].astype(int)
        assert a > b > c >= 0 and total >= others * 5 * 26


def test_hot_tokens_in_pieces(spark, monkeypatch):
    """The same result when tasks hold next to nothing at a time and partitions are many."""
    monkeypatch.setattr(line_dedup, "_HELD", 3)
    monkeypatch.setattr(line_dedup, "PART_TOKENS", 100)
    rng = random.Random(11)
    head = " ".join(f"h{i}" for i in range(30))
    texts = ["\n".join(f"{head} z{rng.randrange(40)}" if rng.random() < 0.5 else f"q{rng.randrange(9)} r" for _ in range(3)) for _ in range(80)]
    gone = lines_by_force(texts)
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, texts).repartition(7)).collect()}
    assert got == {i: len(g) for i, g in gone.items()}


def test_very_long_text(spark):
    """A line of 300,000 words, a copy of it with a few words changed, and one that is half of it."""
    w = [f"w{i % 70_001}" for i in range(300_000)]
    near = [*w]
    near[1000] = near[200_000] = "other"
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, [" ".join(x) for x in (w, near, w[:30_000])])).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_workers_give_memory_back_at_the_end_of_a_task(monkeypatch):
    from wattloom.llm import common

    done = []
    monkeypatch.setattr(common, "release_memory", lambda: done.append(True))
    out = common.releasing(lambda batches: (2 * b for b in batches))(iter([1, 2]))
    assert next(out) == 2 and not done
    assert list(out) == [4] and done == [True]

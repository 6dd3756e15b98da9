"""The pipeline and the registration of the text queries."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wattloom.llm import common, queries


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and len(names) == len(set(names))


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(3000)]
    texts, quality = [], []
    for i in range(300):
        lines = [" ".join(rng.choices(vocab, k=rng.randint(10, 30))) for _ in range(3)]
        t = "\n".join(lines)
        if i % 5 == 0:
            t = t.replace(" ", "$$$ ")
        texts.append(t)
        quality.append(int(i % 5 != 0))
    passage = " ".join(rng.choices(vocab, k=60))
    for i in (11, 22, 33):
        texts[i] += "\n" + passage
    texts[44] = texts[43]
    texts[46] = re.sub(r"\n", " ", texts[47])
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if n < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append({r.doc_id: r.get("text") if hasattr(r, "get") else r.asDict().get("text") for r in docs.collect()})
    assert not set(kept[0]) & {i for i, q in enumerate(quality) if not q} and len(kept[0]) > 230
    assert [passage in kept[1][i] for i in (11, 22, 33) if i in kept[1]] == [True, False, False][: sum(i in kept[1] for i in (11, 22, 33))]
    assert 44 not in kept[1] and 43 in kept[1]
    assert len({46, 47} & set(kept[2])) == 1
    assert docs.where("not round_trip").count() == 0
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.count() == docs.count()


def odd(spark, rows=True):
    """Nulls in every column, empty texts, repeated rows, null ids, and a column that stages may not trip over."""
    long = "\n".join(f"line {i} of a very long text with words {i * 7} {i * 13} {i * 17}" for i in range(3000))
    data = [(1, "some words here\nand there", "en", "a", 20), (1, "some words here\nand there", "en", "a", 20), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "a text without an id", "en", None, 3)]
    data += [(None, "a text without an id", "en", None, 3), (4, long, "en", "a", len(long)), (5, " \n ", None, "c", 3), (6, "one", "en", "c", None)]
    return spark.createDataFrame(data if rows else [], "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit("x") for n in ("kept", "_lines", "shard", "copy", "id")})


@pytest.mark.parametrize("rows", [True, False])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (4, None, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd(spark, rows)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        ids = [r.doc_id for r in out]
        if not rows:
            assert out == []
        elif name == "quality":
            assert len(out) == n
        elif name == "lines":
            # the second row 1 shares the fate of the first, and one line of each pair of equal ones goes
            assert sorted(i for i in ids if i is not None) == [1, 1, 2, 3, 4, 5, 6] and ids.count(None) == 2
        elif name == "near_dups":
            assert len(out) == n
        elif name == "mixture":
            assert {i for i in ids} <= {None, 1, 2, 3, 4, 5, 6} and max(Counter(ids).values()) <= 4
        else:
            assert {i for i in ids} == {None, 1, 2, 3, 4, 5, 6} and all(r.round_trip for r in out)
            assert len({r.perturbed for r in out if r.doc_id == 1}) == 4


def test_run_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_folder", lambda spark: f"file://{tmp_path}/scratch")
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "scratch" / "wattloom").iterdir()}
    assert left == {"mixture"}


@pytest.fixture(scope="module")
def dealt_anew(spark, tmp_path_factory):
    """The smallest tables, with their rows in another order and over other files."""
    d = tmp_path_factory.mktemp("dealt")
    for t in ("documents", "labels", "embeddings", "pages"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").orderBy(F.rand(3)).repartition(5).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["op1_minhash_dedup", "op2_language_id", "op3_embedding_dedup", "op4_sentencepiece_sampling", "op5_line_dedup", "op7_mix_sources", "op8_quality", "op10_toxicity", "op12_spelling_variants", "op13_license_scan"])
def test_reruns_agree(spark, dealt_anew, name):
    """The same rows, numbers to 1e-9, from other files and partitions."""
    frames = []
    for d in ("/root/testdata/sf0.001", dealt_anew):
        f = queries.QUERIES[name](spark, d).toPandas()
        f = f.map(lambda v: v.tolist() if hasattr(v, "tolist") else v)
        numbers = [c for c in f.columns if f[c].dtype.kind == "f"]
        f = f.assign(_at=f.drop(columns=numbers).astype(str).agg("|".join, axis=1)).sort_values(["_at", *numbers]).reset_index(drop=True)
        frames.append((f["_at"], f[numbers].to_numpy(float)))
    (a, x), (b, y) = frames
    assert a.equals(b) and np.allclose(x, y, rtol=0, atol=1e-9, equal_nan=True)

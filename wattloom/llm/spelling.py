"""Spelling variants: words one edit apart, by a dictionary of pairs of numbered trie nodes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import fresh_key, stash, temporary

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Bits of the number of a node or word within its task.
_BITS = 40
#: Distinct words that a task counts before it hands them on.
_HELD = 400_000


def text_words(doc_id: object, text: str | None, least: int, every: int) -> Counter:
    """The words of a text with their counts; one run in every, by its checksum, loses a letter."""
    out: Counter = Counter()
    if not text:
        return out
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
        h = zlib.crc32(w.encode(), head)
        if h % every == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        if len(w) >= least:
            out[w] += n
    return out


def word_counts(df: DataFrame, id_col: str, text_col: str, least: int, occurrences: int, every: int) -> DataFrame:
    """word, n: the words of all texts that occur often enough; tasks add up before the shuffle."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        rows = lambda: pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})
        for f in frames:
            for i, t in zip(f["id"], f["text"], strict=True):
                held.update(text_words(None if pd.isna(i) else i, t, least, every))
                if len(held) > _HELD:
                    yield rows()
                    held.clear()
        yield rows()

    # ids as text, as integers with nulls come to pandas as floats
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _shared(a: str, b: str) -> int:
    """Length of the common head of two words."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def trie_nodes(words: DataFrame, col: str) -> DataFrame:
    """words with part, nth (their order, over all tasks), nodes (the number of the trie node of each of their heads, from
    one letter to the whole word) and repeats (whether each letter equals the one before). Equal heads have equal numbers.

    Words are sorted over ranges. A task numbers the nodes of its own trie; heads that its first word shares with the
    last word of the task before have numbers there, so two words of each task are compared at the driver, and the few
    numbers that differ are replaced.
    """

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, fresh, last, path = TaskContext.get().partitionId(), 0, 0, "", []
        for f in frames:
            nodes, repeats = [], []
            for w in f[col]:
                k = _shared(last, w)
                path = path[:k] + list(range(fresh + 1, fresh + 1 + len(w) - k))
                fresh, last = fresh + len(w) - k, w
                nodes.append(path)
                letters = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
                repeats.append(np.append(False, letters[1:] == letters[:-1]))
            yield f.assign(part=part, nth=range(n, n + len(f)), **{c: pd.Series(x, index=f.index, dtype=object) for c, x in (("nodes", nodes), ("repeats", repeats))})
            n += len(f)

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    dealt = words.repartitionByRange(col).sortWithinPartitions(col)
    own = stash(dealt.mapInPandas(numbered, f"{kind}, part long, nth long, nodes array<long>, repeats array<boolean>"), "trie")
    ends = own.groupBy("part").agg(F.min_by(col, "nth").alias("first"), F.max_by(F.struct(col, "nodes"), "nth").alias("last")).orderBy("part").collect()
    known, before, there = [], "", []
    for r in ends:
        heads = there[: _shared(before, r.first)]
        if heads:
            known.append((r.part, heads))
        before, there = r["last"][0], [heads[x - 1] if x <= len(heads) else (r.part << _BITS) + x for x in r["last"][1]]
    # a row for each task at most
    known = words.sparkSession.createDataFrame(known, "part long, heads array<long>")
    node = lambda x: F.when(x <= F.size("heads"), F.get("heads", (x - 1).cast("int"))).otherwise(F.shiftleft("part", _BITS) + x)
    out = own.join(F.broadcast(known), "part", "left").withColumn("heads", F.coalesce("heads", F.array().cast("array<long>")))
    return out.withColumn("nodes", F.transform("nodes", node)).drop("heads")


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near, best (minus its n, its id) of each word one insertion, deletion or replacement from another.

    words: id, m (minus n), heads and tails (nodes of the trie and of the trie of reversed words, from one letter to the
    whole word), repeats (whether each letter equals the one before). Each word has a key (head, tail) for every letter
    that it skips, and one for every place where it could be cut. Equal keys with a letter skipped on both sides are
    words with one letter replaced, those with a skip and a cut are words with one letter more or less. A key determines
    all letters but one, so a group has at most one cut and as many skips as there are letters (90); its words get the
    group's size and the best other word, not pairs. Of a run of equal letters only the first counts as deleted, so
    that no two words meet twice.
    """
    at = lambda nodes, i: F.when(i > 0, F.get(nodes, i - 1)).otherwise(F.lit(0).cast("long"))
    length = F.size("heads")
    skips = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(at("heads", i).alias("p"), at("tails", length - 1 - i).alias("s"), F.get("repeats", i).cast("byte").alias("kind")))
    cuts = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(at("heads", i).alias("p"), at("tails", length - i).alias("s"), F.lit(2).cast("byte").alias("kind")))
    keys = words.select("id", "m", F.inline(F.concat(skips, cuts)))
    groups = keys.groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct("m", "id", "kind"))).alias("all")).where("size(all) > 1")
    skipped = F.filter("all", lambda e: e["kind"] < 2)
    cut = F.get(F.filter("all", lambda e: e["kind"] == 2), 0)
    groups = groups.select(skipped.alias("skips"), F.filter("all", lambda e: e["kind"] == 0).alias("first"), F.when(cut.isNotNull(), F.struct(cut["m"].alias("m"), cut["id"].alias("id"))).alias("cut"))
    bare = lambda e: F.when(e.isNotNull(), F.struct(e["m"].alias("m"), e["id"].alias("id")))

    def met(e):
        deleted = (e["kind"] == 0) & F.col("cut").isNotNull()
        top, second = F.get("skips", 0), F.get("skips", 1)
        other = F.when(e["id"] == top["id"], bare(second)).otherwise(bare(top))
        return F.struct(e["id"].alias("id"), (F.size("skips") - 1 + deleted.cast("int")).alias("c"), F.least(other, F.when(deleted, F.col("cut"))).alias("best"))

    whole = F.struct(F.col("cut.id").alias("id"), F.size("first").alias("c"), bare(F.get("first", 0)).alias("best"))
    each = groups.select(F.inline(F.concat(F.transform("skips", met), F.when(F.col("cut").isNotNull(), F.array(whole)).otherwise(F.array().cast("array<struct<id:bigint,c:int,best:struct<m:bigint,id:bigint>>>")))))
    return each.where("c > 0").groupBy("id").agg(F.sum("c").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """id, root: the last of each chain of forms (id, form). Every round doubles the links that a row has followed, and a
    link goes to at least the ratio times the count, so rounds are few."""
    roots = stash(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        then = roots.select(F.col("id").alias("root"), F.col("root").alias("then")).withColumn("k", fresh_key("root"))
        out = stash(roots.withColumn("k", fresh_key("root")).join(then, ["k", "root"], "left").select("id", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "roots")
        roots = out.drop("moved")
        if out.where("moved").isEmpty():
            return roots


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, occurrences: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """Each word with its form: word, form, root, n, n_near, form_n.

    Words are maximal runs of [A-Za-zÀ-ÿ] in whole texts, A-Z in lower case, of at least least code points and
    with at least occurrences in all texts together (n). Where the CRC-32 of "id:run" is a multiple of every, the run
    first loses a letter (planted misspellings). Words are near if one insertion, deletion or replacement of a code point
    turns one into the other. The form is the near word of the largest n, of equal ones the first by code points, if it
    has at least ratio times the word's n; else null. root follows forms to the last one. n_near counts near words.

    Null and empty texts have no words. A null id counts as an empty one in the checksum. Rows that repeat an id count
    each. Very long words have two keys a letter, as other words. An empty table gives no rows. Other columns are not
    read.
    """
    with temporary() as keep:
        counts = stash(word_counts(df, id_col, text_col, least, occurrences, every), "words")
        forward = trie_nodes(counts, "word").withColumn("id", F.shiftleft("part", _BITS) + F.col("nth"))
        forward = keep(stash(forward.select("id", "word", "n", F.col("nodes").alias("heads"), "repeats"), "heads"))
        back = trie_nodes(forward.select("id", F.reverse("word").alias("turned")), "turned").select("id", F.col("nodes").alias("tails"))
        near = keep(stash(neighbours(forward.select("id", (-F.col("n")).alias("m"), "heads", "repeats").join(back, "id")), "near"))

        words = forward.select("id", "word", "n")
        found = words.join(near, "id", "left").withColumn("form_n", -F.col("best.m"))
        forms = stash(found.where(F.col("form_n") >= ratio * F.col("n")).select("id", F.col("best.id").alias("form"), "form_n"), "forms")
        named = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word")).withColumn("k", fresh_key(c))
        linked = forms.join(_roots(forms), "id")
        for c in ("form", "root"):
            linked = linked.withColumn("k", fresh_key(c)).join(named(c), ["k", c]).drop("k")
        linked = keep(stash(linked.select("id", "form_word", "root_word", "form_n"), "linked"))
    out = words.join(near.select("id", "n_near"), "id", "left").join(linked, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))

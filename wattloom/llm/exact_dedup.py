"""Exact dedup by recipes of content-defined chunks, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import SPACE, fresh_key, stash

#: Characters with an odd ASCII code, of which boundaries are made.
_ODD = "acegikmoqsuwyACEGIKMOQSUWY13579"
#: A chunk ends where eight characters in a row are odd or not as in this pattern (one place in 256 on mixed text).
_BOUNDARY = "".join(f"[{'' if x == 'o' else '^'}{_ODD}]" for x in "oeeooeoe")


def chunk_pattern(least: int = 512, most: int = 4096) -> str:
    """A regular expression whose successive matches are the chunks of a text."""
    return rf"(?s).{{{least - 8},{most - 8}}}?{_BOUNDARY}|.{{1,{most}}}"


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 512, most: int = 4096) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space. Each text is cut into content-defined chunks. Chunks are
    deduplicated by SHA-256 and by their bytes; a SHA-256 is a verified identifier if all chunks that have it are
    the same bytes. Then only ordered lists of identifiers move: equal lists, equal texts. Should an identifier
    ever stand for two chunks, the lists hold the chunks themselves.

    Of equal texts the row with the most code points in the original, then with the smallest id stays. Null
    text is empty, and all empty texts are equal. Null ids come last; rows that repeat an id count separately and
    are kept together. An empty table gives an empty result. Other columns of df are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).alias("id"), F.char_length(text).alias("n"), F.regexp_replace(text, SPACE + "+", "").alias("norm"))
    chunks = base.select("id", "n", "norm", F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0)).alias("chunks"))

    each = chunks.select(F.explode("chunks").alias("chunk")).select(F.unhex(F.sha2("chunk", 256)).alias("key"), "chunk")
    clashes = each.groupBy("key", "chunk").agg(F.lit(1)).groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1")
    verified = clashes.isEmpty()
    name = (lambda c: F.unhex(F.sha2(c, 256))) if verified else (lambda c: F.encode(c, "UTF-8"))

    recipes = stash(chunks.select("id", "n", F.transform("chunks", name).alias("recipe"), F.sha2("norm", 256).alias("text_sha256")), "recipes")
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    groups = recipes.groupBy("recipe").agg(F.min(order).alias("first"), F.count("*").alias("size")).where("size > 1").withColumn("k", fresh_key("recipe"))
    out = recipes.withColumn("k", fresh_key("recipe")).join(groups, ["k", "recipe"], "left")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("first.id"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""

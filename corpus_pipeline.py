"""A pipeline of five text stages, each written as Parquet and read again as the documents of the next one.

Quality classifier, line dedup, MinHash near-dedup, mixing to target weights, SentencePiece encoding. Each stage works
on all that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import stash, temporary
from wattloom.llm.line_dedup import dedup_lines
from wattloom.llm.minhash import near_duplicates
from wattloom.llm.mixing import mixed_documents
from wattloom.llm.quality import quality_scores
from wattloom.llm.sentencepiece_sampling import default_model, encode_samples

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the table of labels. Rows that repeat an id go if
    one of them is rejected; null and empty texts are judged like others, and rows with null id stay."""
    scored = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = scored.where("predicted = 0").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that match an earlier line; documents of which no line is left go. Null and empty texts
    and rows with null id stay as they are."""
    out = dedup_lines(docs).where("kept")
    n = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*COLUMNS)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words and a similarity of 0.8; of rows that
    repeat an id all stay or go. Texts without words and rows with null id stay."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources ask, in the order of the mix; null is a source of
    its own, the last, and texts without words may be taken."""
    return mixed_documents(docs.select(*COLUMNS))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of the whole texts, with the check that decoding gives the text. Copies of a document that
    the mix made are numbered and have seeds of their own; rows with null id are told apart by a hash of their text."""
    unnamed = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    copy = F.row_number().over(Window.partitionBy("doc_id", unnamed).orderBy(F.xxhash64("text")))
    return encode_samples(docs.withColumn("copy", copy), default_model(), copy_col="copy")


STAGES = [("quality", quality), ("lines", lines), ("near_dups", near_dups), ("mixture", mixture), ("encoding", encoding)]

#: The classifier, sketches and sampled segmentations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary() as keep:
        for name, stage in STAGES[:-1]:
            # what a stage wrote on its way goes when its result is written
            with temporary() as last:
                docs = last(stash(stage(spark, docs, sf_dir), name))
        return STAGES[-1][1](spark, keep(docs), sf_dir)

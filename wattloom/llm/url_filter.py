"""URL verdicts: host and path rules first, then a blocked Bloom filter of listed URLs before an exact join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import fresh_key, stash

#: (verdict, host, path) of the query's rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = 8  # a block is 8 words of 64 bits; a URL sets one bit in each word of its block
#: Blocks that may be broadcast: 16 MB.
BROADCAST_BLOCKS = 1 << 18


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """host without a leading www., path without slashes at its end; empty if there is no host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", "")))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host and path together, the first of equals) that fits; nulls if none."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _places(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a URL, and for each word of the block the bit that the URL sets there."""
    h = F.xxhash64(F.lit(1), url)
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * w).bitwiseAND(F.lit(63)).cast("int")) for w in range(_WORDS)]
    return F.pmod(F.xxhash64(F.lit(2), url), F.lit(blocks)), masks


def blocked_bloom(listed: DataFrame, url_col: str, bits_per_url: int = 16) -> tuple[DataFrame, int]:
    """(filter, blocks): one row of eight 64-bit words for each block that has bits, built by bit_or on the executors."""
    blocks = max(1, math.ceil(listed.count() * bits_per_url / (64 * _WORDS)))
    block, masks = _places(F.col(url_col), blocks)
    bits = listed.select(block.alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(masks)))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS))), blocks


def possible_hits(urls: DataFrame, url_col: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows of urls whose bits are all set. The filter is broadcast only if its blocks fit in 16 MB, else joined."""
    block, masks = _places(F.col(url_col), blocks)
    asked = urls.withColumns({"block": block} | {f"m{i}": m for i, m in enumerate(masks)})
    hit = F.lit(True)
    for i in range(_WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom
    return asked.join(bloom, "block").where(hit).select(urls.columns)


def url_filter(df: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each row of df: id, host, path, rule, verdict, listed.

    The longest rule that fits a URL decides. For the other URLs the list decides: block if the canonical URL is
    listed, else allow. Listed URLs are found by a blocked Bloom filter, whose possible hits an exact join checks.
    Null URLs and those without :// have an empty host and path and are allowed; null and empty list entries
    match nothing. Rows that repeat an id or a URL are judged one by one. Other columns are not read.
    """
    u = F.col("url_")
    split = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url_")).select("id", host_of(u).alias("host"), path_of(u).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = split.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), canonical(F.col("host"), F.col("path")).alias("canon"))

    raw = listed.select(F.col(listed_col).alias("url_"))
    names = stash(raw.select(canonical(host_of(u), path_of(u)).alias("canon")).where("canon <> ''").distinct(), "listed")
    bloom, blocks = blocked_bloom(names, "canon")
    asked = judged.where("rule is null and canon <> ''").select("canon").distinct()
    found = possible_hits(asked, "canon", bloom, blocks).join(names, "canon", "left_semi").select("canon", F.lit(True).alias("hit"), fresh_key("canon").alias("k"))
    out = judged.withColumn("k", F.when(F.col("rule").isNull(), fresh_key("canon"))).join(found, ["k", "canon"], "left")
    hit = F.coalesce("hit", F.lit(False))
    return out.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(hit, "block").otherwise("allow")).alias("verdict"), hit.alias("listed")
    )


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """The list is the URLs of the pages whose id is divisible by 50, as if they had been reported."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter(pages, pages.where(F.col("page_id") % 50 == 0))


OP9_SQL = r"""
WITH s AS (
  SELECT page_id, translate(CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
c AS (
  SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS canon,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM s),
h AS (SELECT *, rule IS NULL AND canon <> '' AND canon IN (SELECT canon FROM c WHERE page_id % 50 = 0) AS listed FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM h
"""

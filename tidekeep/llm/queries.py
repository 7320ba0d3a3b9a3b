"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, language, media, ngram_join, packing, quality, substring_dedup, token_counts, url_filters

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def _list_history(pages: DataFrame) -> DataFrame:
    """A list history over the hosts in `pages`, which have none of their own: dates follow from a hash of the host."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    digit = lambda k: F.ascii(F.substring(F.md5("host"), k, 1))
    day = lambda n: F.timestamp_add("DAY", n, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    added = digit(2) % 20
    removed = added + 5 + digit(3) % 10
    events = F.array(
        F.when(digit(1) % 3 == 0, F.struct(F.lit("domain").alias("kind"), F.lit("add").alias("action"), day(added).alias("at"))),
        F.when((digit(1) % 3 == 0) & (digit(4) % 2 == 0), F.struct(F.lit("domain").alias("kind"), F.lit("remove").alias("action"), day(removed).alias("at"))),
        F.when((digit(1) % 3 == 0) & (digit(5) % 2 == 0), F.struct(F.lit("domain").alias("kind"), F.lit("add").alias("action"), day(removed + 8).alias("at"))),
        F.when(digit(6) % 3 == 1, F.struct(F.lit("prefix").alias("kind"), F.lit("add").alias("action"), day(digit(7) % 25).alias("at"))),
    )
    rows = hosts.select("host", F.explode(F.array_compact(events)).alias("e"))
    pattern = F.when(F.col("e.kind") == "domain", F.col("host")).otherwise(F.concat("host", F.lit("/en")))
    return rows.select(F.lit("block").alias("list"), "e.kind", pattern.alias("pattern"), "e.action", "e.at")


def op2_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.timestamp_add("MINUTE", F.col("page_id") % 43200, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    found = url_filters.evaluate(pages.withColumn("fetched_at", fetched), _list_history(pages))
    return found.select("page_id", "blocked", "n_matches", "pattern")


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op4_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op5_target_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op6_suffix_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(_table(spark, sf_dir, "documents"))


def op7_bulk_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)


def op8_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES: dict[str, Query] = {
    "op1_token_combinations": op1_token_combinations,
    "op2_temporal_list": op2_temporal_list,
    "op3_audio_features": op3_audio_features,
    "op4_rank_order": op4_rank_order,
    "op5_target_ratio": op5_target_ratio,
    "op6_suffix_subtrees": op6_suffix_subtrees,
    "op7_bulk_best_fit": op7_bulk_best_fit,
    "op8_prefix_counts": op8_prefix_counts,
    "op9_text_density": op9_text_density,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_temporal_list": """
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
         regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1) AS path,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id % 43200) AS at
  FROM pages),
h AS (SELECT host, md5(host) AS m FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
d AS (SELECT host, ascii(substr(m, 1, 1)) AS a, ascii(substr(m, 2, 1)) % 20 AS added, ascii(substr(m, 2, 1)) % 20 + 5 + ascii(substr(m, 3, 1)) % 10 AS removed,
             ascii(substr(m, 4, 1)) % 2 AS r, ascii(substr(m, 5, 1)) % 2 AS again, ascii(substr(m, 6, 1)) % 3 AS pre, ascii(substr(m, 7, 1)) % 25 AS pre_day FROM h),
spans AS (
  -- added once; a removal ends it, and a second addition after a removal opens it again (without a removal it changes nothing)
  SELECT 'domain' AS kind, host AS pattern, added AS f, CASE WHEN r = 0 THEN removed END AS t FROM d WHERE a % 3 = 0
  UNION ALL SELECT 'domain', host, removed + 8, NULL FROM d WHERE a % 3 = 0 AND r = 0 AND again = 0
  UNION ALL SELECT 'prefix', host || '/en', pre_day, NULL FROM d WHERE pre = 1),
m AS (
  SELECT p.page_id, s.pattern FROM p JOIN spans s
    ON p.at >= TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(s.f AS INTEGER)) AND (s.t IS NULL OR p.at < TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(s.t AS INTEGER)))
   AND CASE WHEN s.kind = 'domain' THEN p.host = s.pattern OR ends_with(p.host, '.' || s.pattern)
            ELSE p.host || p.path = s.pattern OR starts_with(p.host || p.path, s.pattern || '/') END)
SELECT p.page_id, count(m.pattern) > 0 AS blocked, count(m.pattern) AS n_matches, min(m.pattern) AS pattern
FROM (SELECT DISTINCT page_id FROM p) p LEFT JOIN m ON m.page_id = p.page_id GROUP BY p.page_id
""",
}

"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factweave.llm import fingerprint, jaccard, license_scan, lm_score, media, mixing, quality, secret_scan, sentencepiece_codec, url_filter
from factweave.llm.common import table

#: The same shrinkage in DuckDB's SQL.
OP9_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
), o AS (
  SELECT host, bad FROM p JOIN (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY ALL) ON doc_id = page_id WHERE bad IS NOT NULL
), hn AS (
  SELECT host, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS name, count(*) AS n, sum(bad)::BIGINT AS k FROM o GROUP BY host
), hl AS (
  SELECT *, array_to_string(list_slice(string_split(name, '.'), -2, NULL), '.') AS two, array_to_string(list_slice(string_split(name, '.'), -3, NULL), '.') AS three, regexp_matches(name, '^[0-9]+([.][0-9]+){3}$|^\[') AS num FROM hn
), h AS (
  SELECT host, n, k, CASE WHEN num THEN name WHEN two IN (SUFFIXES) THEN three ELSE two END AS domain, CASE WHEN num THEN '' WHEN two IN (SUFFIXES) THEN two ELSE split_part(name, '.', -1) END AS suffix FROM hl
), d AS (
  SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM h GROUP BY ALL
), s AS (
  SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM d GROUP BY suffix
), raw AS (
  SELECT lv, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, count(*)::DOUBLE AS g, sum(n * n)::DOUBLE AS n2, sum(k * k / n) AS kk
  FROM (SELECT 'h' AS lv, n::DOUBLE AS n, k::DOUBLE AS k FROM h UNION ALL SELECT 'd', n, k FROM d UNION ALL SELECT 's', n, k FROM s) GROUP BY lv
), mom AS (
  SELECT lv, g, k / n AS p, CASE WHEN g > 1 THEN (n - n2 / n) / (g - 1) END AS size, CASE WHEN g > 1 THEN (kk - n * (k / n) * (k / n)) / (g - 1) END AS ms FROM raw
), st AS (
  SELECT lv, CASE WHEN g > 1 AND size > 0 AND (ms - p * (1 - p)) / size > 0
    THEN greatest(1.0, least(1000.0, p * (1 - p) / ((ms - p * (1 - p)) / size) - 1)) ELSE 1000.0 END AS s FROM mom
), sm AS (
  SELECT suffix, ((SELECT s FROM st WHERE lv = 's') * (SELECT (sum(k) + 1) / (sum(n) + 2) FROM s) + k) / ((SELECT s FROM st WHERE lv = 's') + n) AS m FROM s
), dm AS (
  SELECT domain, ((SELECT s FROM st WHERE lv = 'd') * m + k) / ((SELECT s FROM st WHERE lv = 'd') + n) AS m FROM d JOIN sm USING (suffix)
), hm AS (
  SELECT host, n, x.s, (x.s * m + k) / (x.s + n) AS mean FROM h JOIN dm USING (domain), (SELECT s FROM st WHERE lv = 'h') x
), bad AS (
  SELECT host FROM hm WHERE mean - 1.645 * sqrt(mean * (1 - mean) / (s + n + 1)) > 0.5
), r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM r
""".replace("SUFFIXES", ", ".join(f"'{s}'" for s in url_filter.SUFFIXES))

Query = Callable[[SparkSession, str], DataFrame]


def model_path() -> str:
    """The SentencePiece model; FACTWEAVE_PIECE_MODEL names another."""
    if own := os.environ.get("FACTWEAVE_PIECE_MODEL"):
        return own
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), model_path())


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four words and 85 in 100, as the contract fixes."""
    return jaccard.groups(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digest(table(spark, sf_dir, "documents"), model_path())


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes: `labels` by page number; a page is bad if its label has no quality or is toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), model_path())


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_lm_score, op2_jaccard_join, op3_fingerprint, op4_license_scan, op5_mix, op6_sentencepiece, op7_media, op8_quality, op9_url_filter, op10_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": OP9_SQL}

"""Queries of the per-key aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidsieve.operators import keystats


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keystats.hot_keys(spark.read.parquet(f"{sf_dir}/labels_q.parquet"))


def p3_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, mean containment and strongest level of every item and document."""
    return keystats.hits_per_key(spark.read.parquet(f"{sf_dir}/labels_q.parquet"))


QUERIES = {f.__name__: f for f in (p3_found, p3_keys)}

_KEYS = r"""
WITH rows AS (
  SELECT unnest([{'f': 'item_id', 'k': lower(regexp_replace(item_id, '^\s+|\s+$', '', 'g'))}, {'f': 'doc_id', 'k': doc_id}]) AS x,
    CASE WHEN NOT isnan(containment) AND containment BETWEEN 0 AND 1 THEN CAST(containment AS DECIMAL(20,12)) END AS c,
    CASE upper(regexp_replace(level, '[\s _\-]+', '', 'g')) WHEN 'EXACT' THEN 3 WHEN 'NEARDUPLICATE' THEN 2 WHEN 'PARTIAL' THEN 1 WHEN 'NONE' THEN 0 END AS l
  FROM labels_q
), keys AS (
  SELECT x.f AS field_name, x.k AS key_value, count(*) AS hits, CAST(sum(c) AS DOUBLE) / count(c) AS mean_containment,
    ['NONE', 'PARTIAL', 'NEAR_DUPLICATE', 'EXACT'][max(l) + 1] AS strongest
  FROM rows GROUP BY 1, 2
)
"""

SQL = {
    "p3_found": _KEYS + "SELECT field_name, key_value FROM keys WHERE key_value IS NOT NULL AND hits >= 0.03 * (SELECT count(*) FROM labels_q) - 1e-9",
    "p3_keys": _KEYS + "SELECT * FROM keys",
}

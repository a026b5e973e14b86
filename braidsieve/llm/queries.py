"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsieve.llm import canonical, copies, leaks, neardup, oracle, packing, repetition, topn


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, pos, text) of mini_corpus.text and mini_benchmark.question."""
    a = _read(spark, sf_dir, "mini_corpus").select(F.lit("mini_corpus").alias("table_name"), "pos", "text")
    b = _read(spark, sf_dir, "mini_benchmark").select(F.lit("mini_benchmark").alias("table_name"), "pos", F.col("question").alias("text"))
    return a.unionByName(b)


def p1_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest hits of every item with their positions."""
    return topn.strongest_hits(_read(spark, sf_dir, "labels_q"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_top(spark, sf_dir).select("item_id", "hit_id")


def _near(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    return neardup.near_duplicates(_read(spark, sf_dir, "mini_benchmark"), "item_id", "question", k=3, least=0.5)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.id_pairs(_near(spark, sf_dir)).select("id_a", "id_b")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each item with its class, its group and its number of links."""
    return neardup.groups(_near(spark, sf_dir))


def p2_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gsm8k_test_dupes brought into line with the pairs found."""
    return neardup.reconcile(_read(spark, sf_dir, "gsm8k_test_dupes"), _near(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.look_alike_pairs(_texts(spark, sf_dir))[0]


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one consistent text of every row."""
    return canonical.canonical_texts(_texts(spark, sf_dir), "text").select("table_name", "pos", "plain_text", "text_key")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_rows(_texts(spark, sf_dir))[0]


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record with its number of copies."""
    return copies.records(_texts(spark, sf_dir))[0]


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sequence of 2,048 tokens and its place within."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the sequences are."""
    return packing.fill_report(p6_pack(spark, sf_dir))


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of what must hold of a packing: all documents, and no sequence too full or with a gap, no document cut that
    would have fitted, no token without a place."""
    return packing.faults(p6_pack(spark, sf_dir))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items they give away, and the spans of words to remove."""
    return leaks.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_spans(spark, sf_dir).select("doc_id", "item_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of repetition and of content, and whether the field retains it."""
    out = repetition.repetition(_read(spark, sf_dir, "documents"))
    turned_away = (F.col("words") >= repetition.LEAST_WORDS) & (F.col("content_share") <= repetition.retention_cut())
    return out.select("doc_id", "words", "lines", "repeated_share", "content_share", (~turned_away).alias("retained"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(_read(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_top, p2_found, p2_groups, p2_list, p4_found, p4_texts, p5_found, p5_records, p6_pack, p6_fill, p6_check, p7_found, p7_spans, p8_found, p8_shares)
}

_P1 = r"""
WITH clean AS (
  SELECT lower(regexp_replace(item_id, '^\s+|\s+$', '', 'g')) AS item_id, doc_id, hit_id, containment,
    CASE upper(regexp_replace(level, '[\s _\-]+', '', 'g')) WHEN 'EXACT' THEN 3 WHEN 'NEARDUPLICATE' THEN 2 WHEN 'PARTIAL' THEN 1 WHEN 'NONE' THEN 0 END AS rank
  FROM labels_q
), valid AS (
  SELECT * FROM clean WHERE item_id IS NOT NULL AND doc_id IS NOT NULL AND rank IS NOT NULL AND NOT isnan(containment) AND containment BETWEEN 0 AND 1
), one AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY rank DESC, containment DESC, hit_id) AS n FROM valid
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank DESC, containment DESC, hit_id) AS position FROM one WHERE n = 1
)
"""

SQL = oracle.SQL | {
    "p1_found": _P1 + "SELECT item_id, hit_id FROM placed WHERE position <= 3",
    "p1_top": _P1 + "SELECT item_id, hit_id, doc_id, rank, containment, position FROM placed WHERE position <= 3",
}

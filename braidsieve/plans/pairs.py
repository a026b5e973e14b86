"""Queries of similar texts, signatures and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidsieve.functions.hashing import digest_column, gram_value_column, token_hash_column, unit_column
from braidsieve.functions.text import normal_form, token_line
from braidsieve.operators import dupes, lookup, split
from braidsieve.operators.items import QUESTION, view_text
from braidsieve.plans import oracle as sql
from braidsieve.plans.overlap import items, pages


def _sets(spark, sf_dir, k=3):
    return dupes.shingle_sets(items(spark, sf_dir), "item_id", view_text(QUESTION), k)


def near_dup_items(spark, sf_dir):
    """Pairs of items with at least half of their 3-shingles in common, exactly."""
    return dupes.similar_pairs(_sets(spark, sf_dir), least=0.5)


def near_dup_cross(spark, sf_dir):
    """Items of the training split like items of the test split."""
    side = F.lower(F.trim("split"))
    a, b = (dupes.shingle_sets(items(spark, sf_dir).where(side == name), "item_id", view_text(QUESTION), 3) for name in ("train", "test"))
    return dupes.similar_pairs(a, b, least=0.5)


def near_dup_docs(spark, sf_dir):
    """Pairs of pages with at least 0.8 of their 5-shingles in common."""
    return dupes.similar_pairs(dupes.shingle_sets(pages(spark, sf_dir), "doc_key", F.col("text"), 5), least=0.8)


def dupes_by_threshold(spark, sf_dir):
    """How many item pairs reach each threshold."""
    found = near_dup_items(spark, sf_dir)
    return found.agg(*[F.count_if(F.col("jaccard") >= t - 1e-12).alias(n) for t, n in ((0.5, "at_50"), (0.7, "at_70"), (0.9, "at_90"))])


def minhash_signatures(spark, sf_dir):
    return dupes.signatures(_sets(spark, sf_dir), 64)


def lsh_candidates(spark, sf_dir):
    """Banded candidates with estimated and exact similarity."""
    sets = _sets(spark, sf_dir)
    signed = dupes.signatures(sets, 64)
    pairs = dupes.banded_candidates(signed, 16, 4)
    a = signed.join(sets, "id").select(F.col("id").alias("id_a"), F.col("signature").alias("sa"), F.col("shingles").alias("xa"))
    b = signed.join(sets, "id").select(F.col("id").alias("id_b"), F.col("signature").alias("sb"), F.col("shingles").alias("xb"))
    both = pairs.join(a, "id_a").join(b, "id_b")
    return both.select("id_a", "id_b", dupes.estimated_jaccard(F.col("sa"), F.col("sb")).alias("estimate"), dupes.jaccard(F.col("xa"), F.col("xb")).alias("jaccard"))


def split_of_items(spark, sf_dir):
    return split.split_items(items(spark, sf_dir)).select("item_id", "side")


def split_of_documents(spark, sf_dir):
    return split.split_documents(pages(spark, sf_dir)).select("doc_id", "side")


def split_md5(spark, sf_dir):
    return split.split_by_digest(pages(spark, sf_dir), F.col("doc_id")).select("doc_id", "side")


def split_md5_items(spark, sf_dir):
    return split.split_by_digest(items(spark, sf_dir), normal_form("question"), 0.3, 7).select("item_id", "side")


def text_hashes(spark, sf_dir):
    """Digest, unit-interval key and first token's hash of each item's question."""
    q = F.coalesce("question", F.lit(""))
    return items(spark, sf_dir).select("item_id", digest_column(q).alias("digest"), unit_column(0, q).alias("unit"), token_hash_column(F.split_part(token_line(q), F.lit(" "), F.lit(1))).alias("first_token"))


def gram_values(spark, sf_dir):
    """Polynomial hashes of each item's 3-grams."""
    return items(spark, sf_dir).select("item_id", gram_value_column(token_line(F.coalesce("question", F.lit(""))), 3).alias("grams"))


def phrase_context(spark, sf_dir):
    """Text around the phrase in pages, whatever stands between its words."""
    return lookup.phrase_context(pages(spark, sf_dir), "which tool should", 40)


QUERIES = {
    f.__name__: f
    for f in (
        near_dup_items, near_dup_cross, near_dup_docs, dupes_by_threshold, minhash_signatures, lsh_candidates, split_of_items, split_of_documents, split_md5, split_md5_items, text_hashes, gram_values, phrase_context,
    )
}


def _shingles(name: str, source: str, id: str, text: str, k: int) -> str:
    return f"""{name}_t AS (SELECT {id} AS id, {sql.tokens(text)} AS tok FROM {source}),
{name} AS (SELECT id, CASE WHEN len(tok) >= {k} THEN list_distinct({sql.grams('tok', str(k))}) ELSE ['whole: ' || array_to_string(tok, ' ')] END AS s FROM {name}_t WHERE len(tok) > 0)"""


def _pairs(a: str, b: str, order: str, least: float) -> str:
    return f"""u AS (SELECT id, len(s) AS n, unnest(s) AS g FROM {a}), v AS (SELECT id, len(s) AS n, unnest(s) AS g FROM {b}),
c AS (SELECT u.id AS id_a, v.id AS id_b, count(*) AS c, any_value(u.n) AS n, any_value(v.n) AS m FROM u JOIN v ON u.g = v.g AND {order} GROUP BY 1, 2),
p AS (SELECT id_a, id_b, c::DOUBLE / (n + m - c) AS jaccard FROM c WHERE c::DOUBLE / (n + m - c) >= {least} - 1e-12)"""


_Q = sql.view(False)
_SPLIT = "(SELECT * FROM mini_benchmark WHERE lower(trim(split)) = '{}')"
_ITEMS = f"WITH {_shingles('a', 'mini_benchmark', 'item_id', _Q, 3)}, {_pairs('a', 'a', 'u.id < v.id', 0.5)}"
_SIDE = "CASE WHEN ('0x' || substring(md5({0}), 1, 15))::BIGINT::DOUBLE / (1::BIGINT << 60)::DOUBLE < {1} THEN 'dev' ELSE 'test' END AS side"

SQL = {
    "near_dup_items": _ITEMS + " SELECT * FROM p",
    "near_dup_cross": f"WITH {_shingles('a', _SPLIT.format('train'), 'item_id', _Q, 3)}, {_shingles('b', _SPLIT.format('test'), 'item_id', _Q, 3)}, {_pairs('a', 'b', 'u.id <> v.id', 0.5)} SELECT * FROM p",
    "near_dup_docs": f"WITH {_shingles('a', 'documents', 'doc_id', 'text', 5)}, {_pairs('a', 'a', 'u.id < v.id', 0.8)} SELECT * FROM p",
    "dupes_by_threshold": _ITEMS + " SELECT " + ", ".join(f"count(*) FILTER (WHERE jaccard >= {t} - 1e-12) AS {n}" for t, n in ((0.5, "at_50"), (0.7, "at_70"), (0.9, "at_90"))) + " FROM p",
    "split_md5": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_SIDE.format(chr(39) + '0|' + chr(39) + ' || doc_id', 0.5)} FROM documents",
    "split_md5_items": f"SELECT item_id, {_SIDE.format(chr(39) + '7|' + chr(39) + ' || ' + sql.normal('question'), 0.3)} FROM mini_benchmark",
    "phrase_context": r"""SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(regexp_extract(text, '(?is).{0,40}\bwhich\W+tool\W+should\b.{0,40}'), chr(10), ' | ') AS context FROM documents) WHERE context <> ''""",
}

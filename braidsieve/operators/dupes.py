"""Near-duplicate items: exact shingle join, MinHash signatures and banding.

``similar_pairs`` is exact: two sets with Jaccard similarity of at least t share one of the rarest
(size - ceil(t * size) + 1) shingles of either, so only those are joined, and every candidate is verified by its whole sets.
``signatures`` and ``banded_candidates`` are the approximate way: minima of keyed hashes, equal in whole bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidsieve.functions.text import gram_sets, token_line
from braidsieve.operators.expand import member_pairs
from braidsieve.scratch import save
from braidsieve.session import spread


def shingle_sets(df: DataFrame, id: str, text: Column, k: int) -> DataFrame:
    """(id, shingles): distinct k-shingles; a text of fewer than k tokens has one shingle, all of it; empty texts have none."""
    lined = spread(df.select(F.col(id).alias("id"), text.alias("text"))).select("id", token_line(F.col("text")).alias("line")).where("length(line) > 0")
    long = gram_sets("line", [k])
    return lined.select("id", F.when(F.size(long) > 0, long).otherwise(F.array(F.xxhash64("line", F.lit("whole")))).alias("shingles"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - common
    return F.when(whole == 0, 0.0).otherwise(common / whole)


def _rare(sets: DataFrame, df: DataFrame, least: float) -> DataFrame:
    each = sets.select("id", F.size("shingles").alias("size"), F.explode("shingles").alias("s")).join(df, "s")
    ordered = each.groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("df", "s")))["s"].alias("o"))
    keep = F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9).cast("int") + 1
    return ordered.select("id", "size", F.explode(F.slice("o", 1, keep)).alias("s"))


def similar_pairs(left: DataFrame, right: DataFrame | None = None, *, least: float = 0.8) -> DataFrame:
    """(id_a, id_b, jaccard) of shingle sets (id, shingles) with at least ``least``: of one list (id_a < id_b), or of two lists
    (equal ids are skipped)."""
    if not 0 < least <= 1:
        raise ValueError("the threshold must be within (0, 1]")
    a = save(left, "sets").df
    b = a if right is None else save(right, "sets").df
    both = a if right is None else a.unionByName(b)
    df = both.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    rare_a = save(_rare(a, df, least), "rare").df
    rare_b = rare_a if right is None else save(_rare(b, df, least), "rare").df
    ra = rare_a.select(F.col("id").alias("id_a"), F.col("size").alias("size_a"), "s")
    rb = rare_b.select(F.col("id").alias("id_b"), F.col("size").alias("size_b"), "s")
    order = F.col("id_a") < F.col("id_b") if right is None else F.col("id_a") != F.col("id_b")
    lo, hi = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    pairs = save(ra.join(rb, "s").where(order & (lo >= least * hi - 1e-9)).select("id_a", "id_b").distinct(), "pairs").df
    checked = pairs.join(a.select(F.col("id").alias("id_a"), F.col("shingles").alias("x")), "id_a").join(b.select(F.col("id").alias("id_b"), F.col("shingles").alias("y")), "id_b")
    return checked.select("id_a", "id_b", jaccard(F.col("x"), F.col("y")).alias("jaccard")).where(F.col("jaccard") >= least - 1e-12)


def signatures(sets: DataFrame, hashes: int = 128, seed: int = 0) -> DataFrame:
    """(id, signature): for each of ``hashes`` keyed hash functions the least value over the set.  The minima are plain
    aggregates of partial states, so a set may be spread over many rows."""
    each = sets.select("id", F.explode("shingles").alias("s"))
    return each.groupBy("id").agg(F.array(*[F.min(F.xxhash64("s", F.lit(seed * hashes + i))) for i in range(hashes)]).alias("signature"))


def merged_signature(a: Column, b: Column) -> Column:
    """The signature of a union: the least of each position; an error for unlike lengths."""
    same = F.assert_true(F.size(a) == F.size(b), "signatures must have one length")
    return F.when(same.isNull(), F.zip_with(a, b, lambda x, y: F.least(x, y)))


def estimated_jaccard(a: Column, b: Column) -> Column:
    """The share of equal positions; an error for unlike lengths."""
    same = F.assert_true(F.size(a) == F.size(b), "signatures must have one length")
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(same.isNull(), equal / F.size(a))


def banded_candidates(signed: DataFrame, bands: int, rows: int, block: int = 4096) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs whose signatures agree in a whole band.  A band value that many ids share is parted into
    blocks, and each two blocks meet by themselves."""
    ok = F.assert_true(F.size("signature") == bands * rows, "bands x rows must be the signature's length")
    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("signature", i * rows + 1, rows)) for i in range(bands)])
    banded = save(signed.where(ok.isNull()).select("id", F.explode(keys).alias("band")), "bands").df
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    links = sizes.select(F.col("band").alias("band_a"), F.col("band").alias("band_b"))
    return member_pairs(links, banded, ["band"], "id", sizes, block).where("id_a < id_b").select("id_a", "id_b").distinct()

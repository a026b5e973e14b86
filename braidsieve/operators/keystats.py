"""Hits per item and per document, with tree aggregation against hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidsieve.operators.treeagg import tree_aggregate

LEVEL_NAMES = ("NONE", "PARTIAL", "NEAR_DUPLICATE", "EXACT")  # weakest first


def read_level(level: Column) -> Column:
    """0..3 of a level's name in any case, with blanks anywhere and any mark between its words; null for anything else."""
    plain = F.upper(F.regexp_replace(level, r"[\s\x{A0}\x{FEFF}]+", ""))
    rank = F.lit(None).cast("int")
    for i, name in enumerate(LEVEL_NAMES):
        rank = F.when(plain.rlike("^" + name.replace("_", "[^A-Z0-9]*") + "$"), i).otherwise(rank)
    return rank


def hits_per_key(hits: DataFrame) -> DataFrame:
    """(field_name, key_value, hits, mean_containment, strongest): for each item_id (trimmed, lower case) and each doc_id
    the number of hits, the mean of the containments within 0..1, and the strongest level.  Null keys are a row of
    their field.  Containments are summed as decimals, so the mean does not depend on the order of rows."""
    c = F.col("containment")
    valid = c.between(0.0, 1.0) & ~F.isnan(c)
    fields = F.array(
        F.struct(F.lit("item_id").alias("field_name"), F.lower(F.regexp_replace("item_id", r"^\s+|\s+$", "")).alias("key_value")),
        F.struct(F.lit("doc_id").alias("field_name"), F.col("doc_id").alias("key_value")),
    )
    rows = hits.select(F.explode(fields).alias("f"), F.when(valid, c.cast("decimal(20,12)")).alias("c"), read_level(F.col("level")).alias("l")).select("f.*", "c", "l")
    out = tree_aggregate(
        rows,
        ["field_name", "key_value"],
        {"hits": (F.lit(1).cast("bigint"), "sum"), "total": (F.coalesce("c", F.lit(0).cast("decimal(20,12)")), "sum"), "valid": (F.col("c").isNotNull().cast("bigint"), "sum"), "rank": (F.col("l"), "max")},
    )
    mean = F.when(F.col("valid") > 0, F.col("total").cast("double") / F.col("valid"))
    names = F.array(*map(F.lit, LEVEL_NAMES))
    return out.select("field_name", "key_value", "hits", mean.alias("mean_containment"), F.get(names, F.col("rank")).alias("strongest"))


def hot_keys(hits: DataFrame, share: float = 0.03) -> DataFrame:
    """(field_name, key_value) of the non-null keys that hold at least ``share`` of all rows."""
    least = share * hits.count() - 1e-9
    return hits_per_key(hits).where(F.col("key_value").isNotNull() & (F.col("hits") >= least) & (F.col("hits") > 0)).select("field_name", "key_value")

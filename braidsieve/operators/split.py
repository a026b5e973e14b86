"""Splits into dev and test that depend on a seed and a row's own key alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidsieve.functions.hashing import unit_column
from braidsieve.functions.text import normal_form


def _side(u: Column, dev_fraction: float) -> Column:
    if not 0 < dev_fraction < 1:
        raise ValueError("dev_fraction must be strictly between 0 and 1")
    return F.when(u < dev_fraction, "dev").otherwise("test")


def split_items(items: DataFrame, dev_fraction: float = 0.5, seed: int = 0) -> DataFrame:
    """The items with ``side``; items whose questions have one normal form stay together."""
    return items.withColumn("side", _side(unit_column(seed, normal_form(F.coalesce("question", F.lit("")))), dev_fraction))


def split_documents(docs: DataFrame, dev_fraction: float = 0.5, seed: int = 0) -> DataFrame:
    """The documents with ``side``, by id."""
    return docs.withColumn("side", _side(unit_column(seed, F.concat(F.lit("doc|"), "doc_id")), dev_fraction))


def split_by_digest(rows: DataFrame, key: Column, dev_fraction: float = 0.5, seed: int = 0) -> DataFrame:
    """The rows with ``side`` by the first 60 bits of MD5, all within the JVM."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 15), 16, 10).cast("double")
    return rows.withColumn("side", _side(bits / float(1 << 60), dev_fraction))

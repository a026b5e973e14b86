"""Consecutive numbers and running totals in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from braidsieve.scratch import save


def running_before(df: DataFrame, key: str, amount: Column) -> DataFrame:
    """(key, before): the sum of ``amount`` over all rows with a smaller key; keys are unique.

    Rows are range-partitioned by key and saved with their partition's number; each partition sums its own rows, and
    only the partitions' sums (a row each) are accumulated."""
    placed = save(df.select(F.col(key).alias("k"), amount.alias("a")).repartitionByRange("k").withColumn("part", F.spark_partition_id()), "ranges").df
    sums = placed.groupBy("part").agg(F.sum("a").alias("s"))
    earlier = sums.select("part", F.coalesce(F.sum("s").over(W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("a").over(W.Window.partitionBy("part").orderBy("k").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("inside", inside).join(F.broadcast(earlier), "part").select(F.col("k").alias(key), (F.col("earlier") + F.col("inside")).alias("before"))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """(key, number): the rows' places in order of key, from 0."""
    return running_before(df, key, F.lit(1)).withColumnRenamed("before", "number")

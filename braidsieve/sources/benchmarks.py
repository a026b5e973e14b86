"""Benchmark rows of several layouts as items (item_id, benchmark, split, question, choices, answer)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsieve.operators.numbering import numbered
from braidsieve.sources.jsonl import read_jsonl

ITEMS = "item_id string, benchmark string, split string, question string, choices array<string>, answer string"


def _no_choices() -> F.Column:
    return F.array().cast("array<string>")


def gsm8k_items(rows: DataFrame, split: str) -> DataFrame:
    """rows: (index, question, answer)."""
    return rows.select(F.format_string(f"gsm8k:{split}:%d", "index").alias("item_id"), F.lit("gsm8k").alias("benchmark"), F.lit(split).alias("split"), "question", _no_choices().alias("choices"), "answer")


def arc_items(rows: DataFrame, split: str) -> DataFrame:
    """rows: (index, id, question, choices struct(text, label), answerKey); a null id falls back to the index."""
    name = F.concat(F.lit(f"arc_challenge:{split}:"), F.coalesce(F.col("id"), F.col("index").cast("string")))
    return rows.select(name.alias("item_id"), F.lit("arc_challenge").alias("benchmark"), F.lit(split).alias("split"), "question", F.col("choices.text").alias("choices"), F.col("answerKey").alias("answer"))


def mmlu_items(rows: DataFrame, split: str) -> DataFrame:
    """rows: (index, question, choices, answer index); an index outside the choices is an error."""
    inside = (F.col("answer") >= 0) & (F.col("answer") < F.size("choices"))
    letter = F.when(inside, F.char(F.lit(65) + F.col("answer"))).otherwise(F.raise_error(F.format_string("row %d: answer %d is outside the choices", "index", "answer")))
    return rows.select(F.format_string(f"mmlu:{split}:%d", "index").alias("item_id"), F.lit("mmlu").alias("benchmark"), F.lit(split).alias("split"), "question", "choices", letter.alias("answer"))


CONVERTERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"gsm8k": gsm8k_items, "arc_challenge": arc_items, "mmlu": mmlu_items}


def load_benchmark(spark: SparkSession, name: str, path: str, split: str = "test") -> DataFrame:
    """A benchmark's parquet file as items; rows are numbered in file order unless they have an index."""
    if name not in CONVERTERS:
        raise ValueError(f"unknown benchmark {name!r}; there are {sorted(CONVERTERS)}")
    rows = spark.read.parquet(path)
    if "index" not in rows.columns:
        rows = rows.withColumn("_at", F.monotonically_increasing_id())
        rows = rows.join(numbered(rows, "_at").withColumnRenamed("number", "index"), "_at").drop("_at")
    return CONVERTERS[name](rows, split)


def load_items_jsonl(spark: SparkSession, path: str, benchmark: str | None = None) -> DataFrame:
    """Own items from JSON Lines with item_id and question; benchmark defaults to the file's stem, split to test."""
    stem = benchmark or path.rstrip("/").rsplit("/", 1)[-1].split(".", 1)[0]
    rows = read_jsonl(spark, path, ITEMS)
    return rows.select("item_id", F.coalesce("benchmark", F.lit(stem)).alias("benchmark"), F.coalesce("split", F.lit("test")).alias("split"), "question", F.coalesce("choices", _no_choices()).alias("choices"), F.coalesce("answer", F.lit("")).alias("answer"))

"""Labelled hits: cleaning, summaries, agreement, and samples to label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from braidsieve.functions.stats import wilson
from braidsieve.operators.keystats import LEVEL_NAMES, read_level
from braidsieve.scratch import save

# The labels a hit may get, and their one-letter keys.
LABELS = ("true_contamination", "shared_source_text", "coincidental", "benign_discussion")
LABEL_KEYS = {"t": "true_contamination", "p": "shared_source_text", "c": "coincidental", "b": "benign_discussion"}


def read_label(label: Column) -> Column:
    """A label in any case, with blanks around it or as its one-letter key; null for anything else."""
    low = F.lower(F.trim(label))
    name = F.when(low.isin(*LABELS), low)
    for key, label_ in LABEL_KEYS.items():
        name = F.when(low == key, label_).otherwise(name)
    return name


def clean_hits(rows: DataFrame) -> DataFrame:
    """(hit_id, stratum, item_id, doc_id, rank, level, containment, label): ids trimmed, a byte-order mark cut off, levels and
    labels read, containments outside 0..1 null."""
    c = F.col("containment")
    rank = read_level(F.col("level"))
    return rows.select(
        "hit_id",
        F.regexp_replace("stratum", "^\\x{FEFF}", "").alias("stratum"),
        F.lower(F.regexp_replace("item_id", r"^\s+|\s+$", "")).alias("item_id"),
        "doc_id",
        rank.alias("rank"),
        F.get(F.array(*map(F.lit, LEVEL_NAMES)), rank).alias("level"),
        F.when(c.between(0.0, 1.0) & ~F.isnan(c), c).alias("containment"),
        read_label(F.col("label")).alias("label"),
    )


def label_summary(hits: DataFrame) -> DataFrame:
    """Per stratum: labelled hits, each label's count, and the interval of the share of true contamination."""
    rows = hits.groupBy("stratum").agg(F.count("label").alias("labelled"), *[F.count_if(F.col("label") == name).alias(name) for name in LABELS])
    low, high = wilson(F.col(LABELS[0]), F.col("labelled"))
    return rows.select("*", low.alias("true_low"), high.alias("true_high"))


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs: (first, second) labels.  One row: rows, agree, kappa; kappa is 1 where agreement by chance is certain."""
    cells = pairs.where("first is not null and second is not null").groupBy("first", "second").agg(F.count(F.lit(1)).alias("c"))
    one = cells.agg(F.sum("c").alias("rows"), F.coalesce(F.sum(F.when(F.col("first") == F.col("second"), F.col("c"))), F.lit(0)).alias("agree"))
    a = cells.groupBy(F.col("first").alias("label")).agg(F.sum("c").alias("a"))
    b = cells.groupBy(F.col("second").alias("label")).agg(F.sum("c").alias("b"))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("a").cast("double") * F.col("b")), F.lit(0.0)).alias("x"))
    n, p = F.col("rows"), F.col("x") / (F.col("rows").cast("double") * F.col("rows"))
    kappa = F.when(p >= 1, 1.0).otherwise((F.col("agree") / n - p) / (1 - p))
    return one.crossJoin(chance).select("rows", "agree", kappa.alias("kappa"))


def relabelled(hits: DataFrame) -> DataFrame:
    """(item_id, doc_id, first, second): the labels of a pair's first and last hit, where it has several."""
    pair = hits.where("item_id is not null and doc_id is not null").groupBy("item_id", "doc_id")
    ends = pair.agg(F.min_by("label", "hit_id").alias("first"), F.max_by("label", "hit_id").alias("second"), F.count(F.lit(1)).alias("n"))
    return ends.where("n > 1").drop("n")


def _drawn(seed: int) -> Column:
    """A seeded order of hits."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col("hit_id").cast("string")))


def label_sample(hits: DataFrame, top: int = 20, random: int = 20, seed: int = 11) -> DataFrame:
    """Of each stratum the ``top`` hits by containment and ``random`` others in a seeded order of their ids (which are unique):
    the hits with ``part`` (top or random).  Both are limited ranks, which Spark cuts in every task before it moves rows:
    no task sees a stratum as a whole."""
    by = W.Window.partitionBy("stratum")
    strong = by.orderBy(F.col("containment").desc_nulls_last(), "item_id", "doc_id", "hit_id")
    first = hits.withColumn("__n", F.row_number().over(strong)).where(F.col("__n") <= top).drop("__n")
    rest = hits.join(first.select("hit_id"), "hit_id", "left_anti")
    others = rest.withColumn("__n", F.row_number().over(by.orderBy(_drawn(seed), "hit_id"))).where(F.col("__n") <= random).drop("__n")
    return first.withColumn("part", F.lit("top")).unionByName(others.withColumn("part", F.lit("random")))


def first_of_pairs(hits: DataFrame) -> DataFrame:
    """The first hit by hit_id of every (item_id, doc_id)."""
    first = hits.groupBy("item_id", "doc_id").agg(F.min("hit_id").alias("hit_id"))
    return hits.join(first.select("hit_id"), "hit_id", "left_semi")


def annotation_pick(hits: DataFrame, quotas: dict[str, int], seed: int = 0) -> DataFrame:
    """For one label after another up to its quota of hits, in a seeded order, no item twice: (label, item_id, doc_id, hit_id,
    ...).  Of a pair of item and document the first labelled hit counts.  An item taken for one label is passed over for
    the next ones, whose quotas are filled from what is left.  Only picked rows, at most the sum of the quotas, are
    remembered from label to label."""
    unknown = set(quotas) - set(LABELS)
    if unknown:
        raise ValueError(f"unknown labels {sorted(unknown)}")
    labelled = hits.where("label is not null and item_id is not null and doc_id is not null")
    rows = labelled.join(labelled.groupBy("item_id", "doc_id").agg(F.min("hit_id").alias("hit_id")).select("hit_id"), "hit_id", "left_semi")
    out = None
    for label, quota in quotas.items():
        pool = rows.where(F.col("label") == label)
        if out is not None:
            pool = pool.join(out.df.select("item_id"), "item_id", "left_anti")
        one = pool.groupBy("item_id").agg(F.min(F.struct(_drawn(seed).alias("u"), "hit_id")).alias("o"))
        best = one.select("o.*").orderBy("u", "hit_id").limit(quota)
        mine = rows.join(best.select("hit_id"), "hit_id", "left_semi")
        out = save(mine if out is None else out.df.unionByName(mine), "picked")
    return rows.limit(0) if out is None else out.df


def annotation_pack(picked: DataFrame, seed: int = 0) -> DataFrame:
    """One row (hits, answers): the picked hits, without their labels, as a JSON list in a seeded order, and the labels in the
    same order.  ``annotation_pick`` bounds the rows by its quotas, so the lists are small."""
    row = F.struct(F.md5(F.concat(F.lit(f"pack {seed}|"), F.col("hit_id").cast("string"))).alias("at"), F.struct("hit_id", "item_id", "doc_id", "level", "containment").alias("hit"), "label")
    sorted_ = picked.agg(F.array_sort(F.collect_list(row)).alias("r"))
    return sorted_.select(F.to_json(F.col("r.hit")).alias("hits"), F.to_json(F.col("r.label")).alias("answers"))

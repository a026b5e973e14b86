"""Recall and false positives on planted corpora, sweeps over settings, and the choice of an operating point.

Scores hold every overlap at or above the least threshold of interest, and every planted pair whatever its containment; they
are saved once and judged at all thresholds in one aggregation.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidsieve.functions.stats import wilson
from braidsieve.operators.containment import FLOOR, Index, build_index, candidates, score
from braidsieve.operators.items import QUESTION, QUESTION_CHOICES
from braidsieve.operators.plant import PlantedCorpus
from braidsieve.scratch import save


# The fields of an operating point's file.
@dataclass(frozen=True)
class OperatingPoint:
    n: int
    stop_ngram_k: int | None
    view: str
    partial: float
    near_duplicate: float
    macro_recall: float
    control_fpr_upper: float
    window_slack: float | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True) + "\n"

    @staticmethod
    def from_json(text: str) -> OperatingPoint:
        return OperatingPoint.from_record(json.loads(text))

    @staticmethod
    def from_record(found: dict) -> OperatingPoint:
        """Other keys, such as a context, are passed over; a missing window_slack is none."""
        return OperatingPoint(**{k: found[k] for k in OperatingPoint.__dataclass_fields__ if k in found})


def score_corpus(index: Index, corpus: PlantedCorpus, window_slack: float | None = None, floor: float = FLOOR) -> DataFrame:
    """(doc_id, item_id, containment, exact) of all overlaps from ``floor`` on and of all planted pairs; saved."""
    entry_of = index.entries.select("entry", F.explode("item_ids").alias("item_id"))
    planted = corpus.plants.join(entry_of, "item_id").select(F.col("doc_id").alias("doc_key"), "entry")
    pairs = save(candidates(corpus.documents, index, floor).unionByName(planted).distinct(), "pairs").df
    scored = score(corpus.documents, index, pairs, near=FLOOR, window_slack=window_slack).where("matched_ngrams > 0")
    return save(scored.select("doc_id", F.explode("item_ids").alias("item_id"), "containment", "exact"), "scores").df


def _rates(df: DataFrame, k: str, n: str, name: str) -> DataFrame:
    low, high = wilson(F.col(k), F.col(n))
    return df.withColumns({name: F.when(F.col(n) > 0, F.col(k) / F.col(n)).otherwise(0.0), f"{name}_low": low, f"{name}_high": high})


def summarize(corpus: PlantedCorpus, scores: DataFrame, indexed: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """One row for each (partial, near_duplicate) and spec: planted, detected, exact, recall with interval, mean containment (a
    missed plant counts 0), and the grid point's control and foreign counts.  Plants of items not indexed are counted
    apart.  A grid point is a row of thresholds; the scores meet all of them in one pass."""
    spark = scores.sparkSession
    points = F.array(*[F.struct(F.lit(p).alias("partial"), F.lit(q).alias("near_duplicate")) for p, q in grid])

    def at(df: DataFrame) -> DataFrame:
        return df.withColumn("g", F.explode(points)).select("*", "g.*").drop("g")

    flagged: Column = F.coalesce(F.col("exact") | (F.col("containment") >= F.col("partial")), F.lit(False))
    marked = corpus.plants.join(indexed.select("item_id", F.lit(1).alias("in")), "item_id", "left")
    known = at(marked.where("in is not null").join(scores, ["doc_id", "item_id"], "left"))
    rows = known.groupBy("partial", "near_duplicate", "spec", "kind", "intensity").agg(
        F.count(F.lit(1)).alias("planted"), F.count_if(flagged).alias("detected"), F.count_if(flagged & F.coalesce("exact", F.lit(False))).alias("exact"), F.avg(F.coalesce("containment", F.lit(0.0))).alias("mean_containment")
    )
    rows = _rates(rows, "detected", "planted", "recall")
    one = corpus.plants.select("doc_id", F.col("item_id").alias("own"))
    control = corpus.controls.withColumn("control", F.lit(True))
    hits = at(scores.join(one, "doc_id", "left").join(control, "doc_id", "left")).where(flagged)
    is_control = F.coalesce("control", F.lit(False))
    counts = hits.groupBy("partial", "near_duplicate").agg(
        F.count_distinct(F.when(is_control, F.col("doc_id"))).alias("control_flagged"), F.count_if(~is_control & ~F.coalesce(F.col("own") == F.col("item_id"), F.lit(False))).alias("foreign_hits")
    )
    every = spark.createDataFrame(grid, "partial double, near_duplicate double").join(counts, ["partial", "near_duplicate"], "left").na.fill(0)
    whole = every.crossJoin(corpus.controls.agg(F.count(F.lit(1)).alias("control_docs"))).crossJoin(marked.agg(F.count_if(F.col("in").isNull()).alias("unindexed")))
    return rows.join(F.broadcast(_rates(whole, "control_flagged", "control_docs", "control_fpr")), ["partial", "near_duplicate"])


def macro_recall(summary: DataFrame) -> DataFrame:
    """The mean recall over conditions, each counting alike, for each grid point."""
    return summary.where("planted > 0").groupBy("partial", "near_duplicate").agg(F.avg("recall").alias("macro_recall"))


# The columns of a sweep's file, in its order.
SWEEP_SCHEMA = (
    "n int, stop_ngram_k int, view string, partial double, near_duplicate double, spec string, kind string, intensity double, planted bigint, detected bigint, exact bigint, "
    "recall double, recall_low double, recall_high double, mean_containment double, control_docs bigint, control_flagged bigint, control_fpr double, control_fpr_low double, control_fpr_high double, "
    "foreign_hits bigint, unindexed bigint, window_slack double"
)
SWEEP = [part.split()[0] for part in SWEEP_SCHEMA.split(", ")]


def as_sweep_rows(summary: DataFrame, at: OperatingPoint) -> DataFrame:
    """A summary as rows of a sweep."""
    return summary.withColumns({"n": F.lit(at.n), "stop_ngram_k": F.lit(at.stop_ngram_k).cast("int"), "view": F.lit(at.view), "window_slack": F.lit(at.window_slack).cast("double")}).select(SWEEP)


def summary_record(summary: DataFrame) -> dict:
    """A summary at one pair of thresholds (a row for each condition) as one nested record."""
    rows = [r.asDict() for r in summary.orderBy("spec").collect()]
    whole = ("control_docs", "control_flagged", "control_fpr", "control_fpr_low", "control_fpr_high", "foreign_hits", "unindexed")
    own = ("spec", "kind", "intensity", "planted", "detected", "exact", "recall", "recall_low", "recall_high", "mean_containment")
    counted = [r["recall"] for r in rows if r["planted"]]
    return {
        "thresholds": {k: rows[0][k] for k in ("partial", "near_duplicate")} if rows else {},
        "conditions": [{k: r[k] for k in own} for r in rows],
        "macro_recall": sum(counted) / len(counted) if counted else 0.0,
    } | ({k: rows[0][k] for k in whole} if rows else {})


def sweep(
    items: DataFrame,
    corpus: PlantedCorpus,
    *,
    ns: tuple[int, ...] = (5, 8, 13),
    stop_ks: tuple[int | None, ...] = (None,),
    views: tuple[str, ...] = (QUESTION_CHOICES, QUESTION),
    partials: tuple[float, ...] = (0.3, 0.5, 0.7),
    near_duplicates: tuple[float, ...] = (0.8, 0.9),
    window_slacks: tuple[float | None, ...] = (None,),
) -> DataFrame:
    """All settings x conditions (``SWEEP``); each index is built once and each corpus is scored once for a setting."""
    grid = [(p, q) for p in partials for q in near_duplicates if p <= q]
    if not grid:
        raise ValueError("no partial threshold is at or below a near-duplicate threshold")
    out = None
    for view in views:
        for stop_k in stop_ks:
            for n in ns:
                index = build_index(items, view=view, n=n, stop_k=stop_k)
                for slack in window_slacks:
                    scores = score_corpus(index, corpus, slack, min(partials))
                    rows = as_sweep_rows(summarize(corpus, scores, index.item_ids(), grid), OperatingPoint(n, stop_k, view, 0.0, 0.0, 0.0, 0.0, slack))
                    out = rows if out is None else out.unionByName(rows)
    return out


def ranked_points(rows: DataFrame, *, view: str, max_control_fpr_upper: float = 0.05) -> DataFrame:
    """The settings within the bound on control flags, from the best on: macro recall, then stricter thresholds, larger n, no
    stop filter, no window."""
    keys = ["n", "stop_ngram_k", "view", "partial", "near_duplicate", "window_slack"]
    points = rows.where((F.col("view") == view) & (F.col("planted") > 0)).groupBy(keys).agg(F.avg("recall").alias("macro_recall"), F.first("control_fpr_high").alias("control_fpr_upper"))
    within = points.where(F.col("control_fpr_upper") <= max_control_fpr_upper)
    return within.orderBy(F.round("macro_recall", 12).desc(), F.desc("partial"), F.desc("near_duplicate"), F.desc("n"), F.col("stop_ngram_k").isNull().desc(), F.col("window_slack").isNull().desc())


def select_point(rows: DataFrame, *, view: str, max_control_fpr_upper: float = 0.05) -> OperatingPoint:
    """The best setting; an error if none is within the bound."""
    best = ranked_points(rows, view=view, max_control_fpr_upper=max_control_fpr_upper).first()
    if best is None:
        raise ValueError(f"no setting keeps the upper bound of the control rate at or below {max_control_fpr_upper}")
    return OperatingPoint(**{k: best[k] for k in OperatingPoint.__dataclass_fields__})


def evaluate_at(items: DataFrame, corpus: PlantedCorpus, point: OperatingPoint) -> DataFrame:
    """A frozen point's summary on another corpus."""
    index = build_index(items, view=point.view, n=point.n, stop_k=point.stop_ngram_k)
    scores = score_corpus(index, corpus, point.window_slack, point.partial)
    return summarize(corpus, scores, index.item_ids(), [(point.partial, point.near_duplicate)])

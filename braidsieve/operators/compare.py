"""Detectors side by side on one planted corpus."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidsieve.operators.containment import build_index
from braidsieve.operators.evaluate import score_corpus, summarize
from braidsieve.operators.fuzzy import fuzzy_entries, fuzzy_scan
from braidsieve.operators.items import QUESTION
from braidsieve.operators.plant import PlantedCorpus
from braidsieve.scratch import save

COLUMNS = ["method", "spec", "kind", "intensity", "planted", "detected", "recall", "recall_low", "recall_high", "control_docs", "control_flagged", "control_fpr_high", "seconds"]


def compare_methods(
    items: DataFrame, corpus: PlantedCorpus, *, ns: tuple[int, ...] = (2, 3, 5), windowed: tuple[tuple[int, float], ...] = ((3, 1.5),), fuzzy_ks: tuple[int, ...] = (2, 3), least: float = 0.3, view: str = QUESTION,
    hashes: int = 64, bands: int = 32, seed: int = 0,
) -> DataFrame:
    """Recall of each condition and flagged controls for each method, at one threshold; seconds include building the index."""
    grid = [(least, max(0.8, least))]
    out = None

    def add(name: str, began: float, scores: DataFrame, indexed: DataFrame) -> None:
        nonlocal out
        scores.count()
        seconds = time.perf_counter() - began
        rows = summarize(corpus, scores, indexed, grid).withColumns({"method": F.lit(name), "seconds": F.lit(seconds)}).select(COLUMNS)
        out = rows if out is None else out.unionByName(rows)

    for n, slack in [*((n, None) for n in ns), *windowed]:
        began = time.perf_counter()
        index = build_index(items, view=view, n=n)
        name = f"exact n={n}" if slack is None else f"windowed n={n} slack={slack:g}"
        add(name, began, score_corpus(index, corpus, slack, least), index.item_ids())
    for k in fuzzy_ks:
        began = time.perf_counter()
        hits = fuzzy_scan(corpus.documents, items, view=view, k=k, least=least, hashes=hashes, bands=bands, seed=seed)
        scores = save(hits.select("doc_id", "item_id", "containment", F.lit(False).alias("exact")), "fuzzy").df
        entries, _ = fuzzy_entries(items, view=view, k=k)
        add(f"fuzzy k={k}", began, scores, entries.select(F.explode("item_ids").alias("item_id")))
    return out

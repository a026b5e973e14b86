"""Charts of evaluations, where matplotlib is installed; the tables behind them are ordinary DataFrames."""

from __future__ import annotations

import importlib.util
import io
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def available() -> bool:
    return importlib.util.find_spec("matplotlib") is not None


def _axes() -> Any:
    if not available():
        raise RuntimeError("charts need matplotlib")
    from matplotlib.figure import Figure

    return Figure(layout="tight").subplots()


def edit_rate_table(rows: DataFrame, *, view: str, partial: float, near_duplicate: float, window_slack: float | None = None) -> DataFrame:
    """(kind, n, stop_ngram_k, intensity, recall) of the graded word edits, for one view, window and pair of thresholds."""
    at = (F.col("view") == view) & (F.col("partial") == partial) & (F.col("near_duplicate") == near_duplicate) & F.col("window_slack").eqNullSafe(F.lit(window_slack).cast("double"))
    return rows.where(at & F.col("kind").isin("word_delete", "word_substitute")).select("kind", "n", "stop_ngram_k", "intensity", "recall").orderBy("kind", "n", "stop_ngram_k", "intensity")


def edit_rate_chart(table: DataFrame) -> Any:
    """One line for each kind and n (a few dozen rows)."""
    ax = _axes()
    lines: dict[tuple, list[tuple[float, float]]] = {}
    for r in table.collect():
        lines.setdefault((r["kind"], r["n"], r["stop_ngram_k"]), []).append((r["intensity"], r["recall"]))
    for (kind, n, stop), points in lines.items():
        ax.plot(*zip(*points), marker="o", label=f"{kind} n={n}" + (f" stop={stop}" if stop else ""))
    ax.set(xlabel="share of words edited", ylabel="recall", ylim=(0, 1.02))
    if lines:
        ax.legend()
    return ax.figure


def recall_chart(summary: DataFrame) -> Any:
    """One bar for each condition, with its interval."""
    ax = _axes()
    rows = summary.orderBy("spec").collect()
    ends = [[max(0.0, r["recall"] - r["recall_low"]) for r in rows], [max(0.0, r["recall_high"] - r["recall"]) for r in rows]]
    ax.barh([r["spec"] for r in rows], [r["recall"] for r in rows], xerr=ends)
    ax.set(xlabel="recall", xlim=(0, 1.02))
    return ax.figure


def save(figure: Any, spark: SparkSession, path: str) -> None:
    """A chart as PNG on any file system Spark reaches."""
    held = io.BytesIO()
    figure.savefig(held, format="png")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(held.getvalue()))
    out.close()

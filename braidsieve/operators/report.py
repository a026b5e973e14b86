"""What a scan's hits say about the items: strongest levels, shares with intervals, lengths, comparisons.

Hits need (item_id, rank, containment) and what a function names besides; ``rank`` is 0..3.  An item counts once, at its
strongest level.  Groups without hits stay, with zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidsieve.functions.stats import newcombe, wilson
from braidsieve.operators.items import benchmark_of


def strongest(hits: DataFrame) -> DataFrame:
    """(item_id, rank) of every item with a hit."""
    return hits.groupBy("item_id").agg(F.max("rank").alias("rank"))


def _counts(rank: Column) -> list[Column]:
    return [F.count_if(F.coalesce(rank, F.lit(0)) >= level).alias(name) for level, name in ((1, "partial_or_more"), (2, "near_or_more"), (3, "exact"))]


def _with_intervals(df: DataFrame, n: str, names: tuple[str, ...] = ("partial_or_more", "near_or_more", "exact")) -> DataFrame:
    for name in names:
        low, high = wilson(F.col(name), F.col(n))
        df = df.withColumn(f"{name}_low", low).withColumn(f"{name}_high", high)
    return df


def headline(items: DataFrame, indexed: DataFrame, hits: DataFrame) -> DataFrame:
    """Per benchmark: items, indexed items, and of these how many reach each level, with Wilson intervals."""
    known = items.select("item_id").join(indexed.select("item_id", F.lit(1).alias("in")), "item_id", "left").join(strongest(hits), "item_id", "left")
    rank = F.when(F.col("in").isNotNull(), F.col("rank"))
    rows = known.groupBy(benchmark_of(F.col("item_id")).alias("benchmark")).agg(F.count(F.lit(1)).alias("items"), F.count("in").alias("indexed"), *_counts(rank))
    return _with_intervals(rows, "indexed")


def top_hits(hits: DataFrame, n: int, *ties: str) -> DataFrame:
    """The n strongest hits, by level, containment, item and ``ties``."""
    return hits.orderBy(F.col("rank").desc(), F.col("containment").desc(), "item_id", *ties).limit(n)


def filter_hits(hits: DataFrame, lengths: DataFrame, min_tokens: int, min_rank: int = 1) -> DataFrame:
    """Hits of items with enough tokens (lengths: item_id, tokens) and a strong enough level."""
    return hits.join(lengths.where(F.col("tokens") >= min_tokens).select("item_id"), "item_id", "left_semi").where(F.col("rank") >= min_rank)


def flag_rates(lengths: DataFrame, skipped: DataFrame, hits: DataFrame, minimums: list[int]) -> DataFrame:
    """For each least length: eligible items and how many reach each level, with intervals."""
    known = lengths.join(skipped.select("item_id"), "item_id", "left_anti").join(strongest(hits), "item_id", "left")
    each = known.select("rank", F.explode(F.filter(F.array(*map(F.lit, sorted(set(minimums)))), lambda m: m <= F.col("tokens"))).alias("min_tokens"))
    found = each.groupBy("min_tokens").agg(F.count(F.lit(1)).alias("eligible"), *_counts(F.col("rank")))
    wanted = lengths.sparkSession.createDataFrame([(m,) for m in sorted(set(minimums))], "min_tokens int")
    whole = wanted.join(found, "min_tokens", "left").na.fill(0)
    return _with_intervals(whole, "eligible", ("partial_or_more", "near_or_more"))


def hits_by_length(hits: DataFrame, lengths: DataFrame, short_below: int = 15) -> DataFrame:
    """Hits and distinct items of short and of long items."""
    bucket = F.when(F.col("tokens") < short_below, "short").otherwise("long")
    return hits.join(lengths, "item_id").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("item_id").alias("items"))


def compare_scans(eligible_a: DataFrame, eligible_b: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """For each benchmark and level: the items eligible in each scan, those flagged in a, in b, in both and in one only, and the
    difference of the flagged shares with its interval (null where a scan has no eligible item).  One pass over the
    items, joined once with each scan's strongest levels."""
    items = eligible_a.select("item_id", F.lit(True).alias("ea")).join(eligible_b.select("item_id", F.lit(True).alias("eb")), "item_id", "full")
    both = items.join(strongest(a).withColumnRenamed("rank", "a"), "item_id", "left").join(strongest(b).withColumnRenamed("rank", "b"), "item_id", "left")
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("level")) for i, n in ((1, "PARTIAL"), (2, "NEAR_DUPLICATE"), (3, "EXACT"))])).alias("l")
    in_a, in_b = (F.coalesce(F.col(f"e{s}") & (F.col(s) >= F.col("l.rank")), F.lit(False)) for s in "ab")
    rows = both.select(benchmark_of(F.col("item_id")).alias("benchmark"), "ea", "eb", "a", "b", levels).groupBy("benchmark", "l.level").agg(
        F.count("ea").alias("eligible_a"), F.count("eb").alias("eligible_b"), F.count_if(in_a).alias("in_a"), F.count_if(in_b).alias("in_b"), F.count_if(in_a & in_b).alias("in_both"), F.count_if(in_a & ~in_b).alias("only_a"), F.count_if(in_b & ~in_a).alias("only_b")
    )
    diff, low, high = newcombe(F.col("in_a"), F.col("eligible_a"), F.col("in_b"), F.col("eligible_b"))
    return rows.select("*", diff.alias("difference"), low.alias("difference_low"), high.alias("difference_high"))


def labelled_shares(eligible: DataFrame, hits: DataFrame, scan: Column) -> DataFrame:
    """For each scan (a column of the hits) and benchmark: eligible items, the items with a hit labelled true contamination (t),
    and those labelled so or as benign discussion (t_or_b), with intervals of their shares of the eligible items.  A scan
    without such labels has no row."""
    sizes = eligible.groupBy(benchmark_of(F.col("item_id")).alias("benchmark")).agg(F.count(F.lit(1)).alias("eligible"))
    marked = hits.where(F.col("label").isin("true_contamination", "benign_discussion")).join(eligible.select("item_id"), "item_id", "left_semi")
    items = marked.groupBy(scan.alias("scan"), "item_id").agg(F.max(F.when(F.col("label") == "true_contamination", 1).otherwise(0)).alias("t"))
    rows = items.groupBy("scan", benchmark_of(F.col("item_id")).alias("benchmark")).agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("t_or_b")).join(sizes, "benchmark")
    return _with_intervals(rows.select("scan", "benchmark", "eligible", "t", "t_or_b"), "eligible", ("t", "t_or_b"))


def hits_per_million(hits: DataFrame, tokens: DataFrame) -> DataFrame:
    """Hits per million tokens; tokens: one row (tokens)."""
    return hits.agg(F.count(F.lit(1)).alias("hits")).crossJoin(tokens).select("hits", "tokens", (1e6 * F.col("hits") / F.greatest("tokens", F.lit(1))).alias("per_million"))


def show_report(rows: DataFrame, top: DataFrame, progress: dict | None = None, skipped: int | None = None) -> str:
    """The headline and top hits as text; both are small by construction (benchmarks; top n).  progress: documents, tokens, hits
    and finished of a scan; skipped: items that could not be searched."""
    lines = []
    if progress is not None:
        state = "finished" if progress["finished"] else "not finished"
        lines.append(f"scan {state}: {progress['documents']} documents, {progress['tokens']} tokens, {progress['hits']} hits")
    lines.append(f"{'benchmark':16}{'items':>8}{'indexed':>9}{'partial+':>26}{'near+':>26}{'exact':>7}")
    for r in rows.orderBy("benchmark").collect():
        cells = [f"{r[c]} [{100 * r[c + '_low']:.2f}%, {100 * r[c + '_high']:.2f}%]" for c in ("partial_or_more", "near_or_more")]
        lines.append(f"{r['benchmark']:16}{r['items']:>8}{r['indexed']:>9}{cells[0]:>26}{cells[1]:>26}{r['exact']:>7}")
    if skipped is not None:
        lines.append(f"items not searched: {skipped}")
    for r in top.collect():
        lines.append(f"{r['level']:15} {r['containment']:.2f}  {r['item_id']}  in  {r['doc_id']}")
        if "snippet" in top.columns and r["snippet"]:
            lines.append(f"{'':16}{r['snippet'][:110]}")
    return "\n".join(lines)

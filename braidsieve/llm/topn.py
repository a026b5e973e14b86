"""The N best rows of every group, by exact positions in one global order (problem 1).

The rows are range-partitioned and sorted by group, score and identifier.  Each partition numbers its rows within each
group and keeps at most N of them; the counts kept per (group, partition) are prefix-summed over the partitions, which
turns local into global positions.  A count cut off at N is enough: where it is cut off, nothing behind it can be among
the first N.  So one group may fill many partitions, and no task ever holds more than N rows for each partition of a group.

Ties in the order fall to the next column; give a unique last column for a result that is the same every time.  Nulls
are a group like any other; where they sort among scores is the order's choice.  An empty table gives an empty result, repeated
rows each take a position, and columns of the input keep their names: if one is called ``position``, the added column is
``position_``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W


def _same_as_before(col: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    codes = pc.fill_null(col.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    out = np.zeros(len(codes), bool)
    out[1:] = codes[1:] == codes[:-1]
    if last is not None and len(codes):
        a, b = col[0].as_py(), last.as_py()
        out[0] = a == b
    return out


def unused(name: str, taken: Sequence[str]) -> str:
    """The name, with underscores behind it until no column has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def _number(groups: list[int], n: int, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, before = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.ones(batch.num_rows, bool)
            for i, g in enumerate(groups):
                same &= _same_as_before(batch.column(g), last[i] if last else None)
            starts = np.flatnonzero(~same)
            at = np.arange(batch.num_rows)
            first = np.zeros(batch.num_rows, np.int64)
            first[starts] = starts
            first = np.maximum.accumulate(first)
            local = at - first + 1
            local[: starts[0] if len(starts) else batch.num_rows] += before
            before, last = int(local[-1]), [batch.column(g)[batch.num_rows - 1] for g in groups]
            keep = pa.array(local <= n)
            out = batch.append_column(names[0], pa.array(local)).append_column(names[1], pa.array(np.full(batch.num_rows, part, np.int64)))
            yield out.filter(keep)

    return run


def top_in_groups(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """``df`` with ``position`` (1..n), only the first n rows of each group in ``order``."""
    if n < 1:
        raise ValueError("n must be at least 1")
    at, local, part = (unused(c, df.columns) for c in ("position", "__local", "__part"))
    keys = [F.col(f"`{g}`").asc_nulls_first() for g in groups]
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*df.schema.fields, T.StructField(local, T.LongType()), T.StructField(part, T.LongType())])
    kept = ordered.mapInArrow(_number([df.columns.index(g) for g in groups], n, (local, part)), schema)
    earlier = W.Window.partitionBy(*[F.col(f"`{g}`") for g in groups]).orderBy(part).rangeBetween(W.Window.unboundedPreceding, -1)
    placed = kept.withColumn(at, F.col(local) + F.count(F.lit(1)).over(earlier))
    return placed.where(F.col(at) <= n).drop(local, part)


# The levels as regular expressions of their names without blanks, and their ranks.
RANKS = (("EXACT", 3), ("NEAR[^A-Z0-9]*DUPLICATE", 2), ("PARTIAL", 1), ("NONE", 0))


def level_rank(level: Column) -> Column:
    """3 EXACT, 2 NEAR_DUPLICATE, 1 PARTIAL, 0 NONE, read without regard to case, blanks and the mark between words; null
    for anything else."""
    plain = F.upper(F.regexp_replace(level, r"[\s\x{A0}\x{FEFF}]+", ""))
    rank = F.lit(None).cast("int")
    for name, value in RANKS:
        rank = F.when(plain.rlike(f"^{name}$"), value).otherwise(rank)
    return rank


def strongest_hits(hits: DataFrame, n: int = 3) -> DataFrame:
    """For every item its n strongest hits of different documents: (item_id, hit_id, doc_id, rank, containment, position)."""
    c = F.col("containment")
    rows = (
        hits.select(F.lower(F.regexp_replace("item_id", r"^\s+|\s+$", "")).alias("item_id"), "doc_id", level_rank(F.col("level")).alias("rank"), (c + F.lit(0.0)).alias("containment"), "hit_id")
        .where(F.col("item_id").isNotNull() & F.col("doc_id").isNotNull() & F.col("rank").isNotNull() & F.col("containment").between(0.0, 1.0) & ~F.isnan("containment"))
    )
    best = rows.groupBy("item_id", "doc_id").agg(F.min(F.struct((-F.col("rank")).alias("r"), (-F.col("containment")).alias("c"), F.col("hit_id").alias("h"))).alias("b"))
    one = best.select("item_id", F.col("b.h").alias("hit_id"), "doc_id", (-F.col("b.r")).alias("rank"), (F.lit(0.0) - F.col("b.c")).alias("containment"))
    return top_in_groups(one, ["item_id"], [F.col("rank").desc(), F.col("containment").desc(), F.col("hit_id").asc()], n)

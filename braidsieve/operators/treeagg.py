"""Per-key aggregates when a few keys hold most records: multi-level tree aggregation.

Every task combines its chunk of the input (one scan split, of the fixed size ``spark.sql.files.maxPartitionBytes``) into one
state for each key.  The states then merge through rounds: chunk numbers are divided by ``fan_in``, and the states of one key
that share the quotient meet in one reducer, until one node is left.  The rounds follow from the number of chunks, so a
reducer receives at most ``fan_in`` states of a key, however many rows or chunks the key has.

Null keys form a group like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}
NODE = "__node"


def tree_nodes(chunks: int, fan_in: int) -> list[int]:
    """The nodes left after each round; the last is 1."""
    out = [-(-max(1, chunks) // fan_in)]
    while out[-1] > 1:
        out.append(-(-out[-1] // fan_in))
    return out


def local_states(df: DataFrame, keys: Sequence[str], states: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """(keys, states, node): the values of each row, numbered by the chunk they are in."""
    return df.select(*[F.col(f"`{k}`") for k in keys], *[v.alias(s) for s, (v, _) in states.items()], F.spark_partition_id().alias(NODE))


def merged(now: DataFrame, keys: Sequence[str], states: Mapping[str, tuple[Column, str]], fan_in: int, last: bool) -> DataFrame:
    """One round: the states of each key and ``fan_in`` neighbouring nodes; in the last round of each key."""
    node = [] if last else [NODE]
    up = now if last else now.withColumn(NODE, F.floor(F.col(NODE) / fan_in).cast("int"))
    return up.groupBy(*[F.col(f"`{k}`") for k in keys], *node).agg(*[_MERGE[how](s).alias(s) for s, (_, how) in states.items()])


def tree_aggregate(df: DataFrame, keys: Sequence[str], states: Mapping[str, tuple[Column, str]], fan_in: int = 32, chunks: int | None = None) -> DataFrame:
    """(keys, states): each state is (value of a row, how values merge: sum, min or max).  ``chunks`` is the number of the
    input's partitions; it is read from the plan, which is meant for scans (a plan with shuffles would run them)."""
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    if chunks is None:
        chunks = df._jdf.queryExecution().toRdd().getNumPartitions()
    now = local_states(df, keys, states)
    for nodes in tree_nodes(chunks, fan_in):
        now = merged(now, keys, states, fan_in, nodes == 1)
    return now

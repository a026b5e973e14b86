"""All pairs of members of linked groups, without a task that holds a large group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def member_pairs(links: DataFrame, members: DataFrame, keys: Sequence[str], id: str, sizes: DataFrame, block: int = 4096) -> DataFrame:
    """``links`` names two groups by ``{key}_a`` and ``{key}_b`` (a group may be linked with itself), ``members`` are rows of
    (keys, id), ``sizes`` has the rows ``c`` of each group.  The links' rows, once for each pair of a member of the one and
    a member of the other: ``{id}_a``, ``{id}_b``.

    A group of more than ``block`` members is parted by a hash of the id, and a link of large groups is a row for each two
    parts, so a key of the join has about ``block`` rows on either side."""
    keys = list(keys)
    zero, k = F.lit(0).cast("long"), F.ceil(F.col("c") / block).cast("long")
    parts = sizes.where(F.col("c") > block).select(*keys, k.alias("__k"))
    part = F.when(F.col("__k").isNull(), zero).otherwise(F.pmod(F.xxhash64(id), F.col("__k")))
    placed = members.select(*keys, id).join(parts, keys, "left").select(*keys, id, part.alias("__p"))
    out = links
    for s in "ab":
        own = parts.select(*[F.col(c).alias(f"{c}_{s}") for c in keys], "__k")
        every = F.explode(F.sequence(zero, F.coalesce(F.col("__k"), F.lit(1).cast("long")) - 1))
        out = out.join(own, [f"{c}_{s}" for c in keys], "left").withColumn(f"__p_{s}", every).drop("__k")
    for s in "ab":
        side = placed.select(*[F.col(c).alias(f"{c}_{s}") for c in [*keys, id]], F.col("__p").alias(f"__p_{s}"))
        out = out.join(side, [*[f"{c}_{s}" for c in keys], f"__p_{s}"])
    return out.drop("__p_a", "__p_b")

"""Connected components by alternating large-star and small-star.

``large_star``: every node links its larger neighbours to the least node of its neighbourhood; ``small_star``: every node
links its smaller neighbours and itself to the least of them.  They alternate until the set of links no longer changes;
then every node is linked to the least node of its component.  The least neighbour is a partial aggregate joined back,
by broadcast for the nodes with more than a fixed share of all links, so no neighbourhood is ever gathered in one task;
each round is a table in the shared folder.

Self-links name a node and add no link; nulls are left out; repeated and reversed links count once.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidsieve.operators.skew import skewed_join
from braidsieve.scratch import Saved, save


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("c"))
    return skewed_join(both.where(F.col("v") > F.col("u")), near, ["u"], "c", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    moved = skewed_join(down, near, ["u"], "c", total).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> tuple[DataFrame, Saved]:
    """(node, component) for every node of a link, the component being its least node; and the saved table behind it."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    alone = pairs.where(F.col("u") == F.col("v")).select(F.col("u").alias("node"), F.col("u").alias("component"))
    now = save(pairs.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        large = save(_large_star(now.df, now.rows), "links")
        new = save(_small_star(large.df, large.rows).where(F.col("u") != F.col("v")).distinct(), "links")
        now.drop(), large.drop()
        now = new
        x = F.xxhash64("u", "v").cast("decimal(38,0)")
        found = tuple(now.df.agg(F.count(F.lit(1)), F.sum(x)).first())
        if found == state:
            break
        state = found
    else:
        raise RuntimeError("the links did not settle")
    star = now.df
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component"))
    nodes = star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).unionByName(alone)
    return nodes.groupBy("node").agg(F.min("component").alias("component")), now

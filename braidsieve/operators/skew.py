"""Joins that stay even where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_PARTS = 4096


def skewed_join(many: DataFrame, few: DataFrame, on: Sequence[str], rows: str, total: int, parts: int = HOT_PARTS) -> DataFrame:
    """``many`` joined with ``few`` (one row a key), whose column ``rows`` says how many rows of ``many`` have the key.

    A key with more than 1 / ``parts`` of the ``total`` rows is hot.  There are fewer than ``parts`` hot keys, so their rows of
    ``few`` are broadcast and their rows of ``many`` are not moved; all others meet by the plan that Spark chooses.  Rows
    without a partner are left out; nulls join nothing."""
    on = list(on)
    hot = F.col(rows) > F.lit(total / parts)
    warm = few.where(hot)
    cold = many.join(F.broadcast(warm.select(on)), on, "left_anti").join(few.where(~hot), on)
    return cold.unionByName(many.join(F.broadcast(warm), on))

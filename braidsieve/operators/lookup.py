"""Looking at single documents: by id, and around a phrase."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def find_documents(rows: DataFrame, ids: list[str], id: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """(doc_id, found, text) for every wanted id, of at most ``most`` ids.  The stored column is compared with values of its
    own type, so the filter reaches the scan; an id that cannot be one is not found."""
    ids = list(dict.fromkeys(ids))[:most]
    wanted = rows.sparkSession.createDataFrame([(i,) for i in ids], "doc_id string")
    kind = rows.schema[id].dataType
    if isinstance(kind, T.IntegralType):
        known = [int(i) for i in ids if re.fullmatch(r"-?\d{1,18}", i) and str(int(i)) == i]
    else:
        known = ids
    there = rows.where(F.col(id).isin(known)).select(F.col(id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    return wanted.join(there, "doc_id", "left").select("doc_id", F.col("text").isNotNull().alias("found"), "text")


def phrase_context(docs: DataFrame, phrase: str, width: int = 400) -> DataFrame:
    """(doc_id, context): up to ``width`` characters on either side of the first place where the phrase's words follow one
    another, whatever stands between them and in any case; line breaks are shown as `` | ``."""
    words = re.findall(r"\w+", phrase)
    if not words:
        raise ValueError("the phrase has no word")
    pattern = r"(?is).{0,%d}\b%s\b.{0,%d}" % (width, r"\W+".join(words), width)
    found = F.regexp_replace(F.regexp_extract("text", pattern, 0), "\n", " | ")
    return docs.select("doc_id", found.alias("context")).where("context <> ''")

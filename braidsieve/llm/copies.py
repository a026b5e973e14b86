"""Records that differ only in the way they are written (problem 5).

Rows are copies if they have the same words in the same order; a record card of three or more ``name: value`` fields is the
same in any order of its fields.  A text whose words run like those of a record card in some row is a copy of it too,
and cards joined by such a text are one record.

The canonical keys that hold more than 1 / ``hot_parts`` of all rows are found exactly from partial counts (there are fewer
than ``hot_parts`` of them, so they can be broadcast); those are aggregated in two levels over ``salts`` salts, all
others in one shuffle.  The copy with the least id represents a record.

Defined results: null texts and texts without words are left out; exact copies count; an empty table gives an empty
result.  128-bit digests stand for keys.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidsieve.llm import text as tx
from braidsieve.llm.canonical import digest
from braidsieve.llm.components import connected_components
from braidsieve.scratch import Saved, save
from braidsieve.session import spread


def written_keys(text: str | None) -> dict | None:
    """``seq``: digest of the words in order; ``rec``: of the fields in any order, if the text is a record card."""
    if not text:
        return None
    plain = tx.plain_form(text)
    fields = tx.record_fields(plain)
    if fields is None:
        words = tx.words_of(plain)
        return {"seq": digest(" ".join(words)), "rec": None} if words else None
    parts = [" ".join(tx.words_of(f)) for f in fields]
    return {"seq": digest(" ".join(parts)), "rec": digest("\x1e".join(sorted(parts)))}


_keys = tx.column(
    written_keys,
    T.StructType([T.StructField("seq", T.StringType()), T.StructField("rec", T.StringType())]),
    pa.struct([("seq", pa.string()), ("rec", pa.string())]),
)


def canonical_keys(rows: DataFrame) -> Saved:
    """rows: (table_name, pos, text).  A saved table (table_name, pos, key), one row for each text with words."""
    raw = save(spread(rows.select("table_name", "pos", "text")).select("table_name", "pos", _keys("text").alias("k")).where("k is not null").select("table_name", "pos", "k.*"), "keys")
    cards = raw.df.where("rec is not null")
    by_seq = cards.groupBy("table_name", "seq").agg(F.min("rec").alias("card"), F.max("rec").alias("other"))
    df = raw.df.join(by_seq.drop("other"), ["table_name", "seq"], "left").withColumn("key", F.coalesce("rec", "card", "seq"))
    unlike = by_seq.where("card <> other")
    if not unlike.isEmpty():
        # one run of words that parts into unlike cards makes them one record
        links = cards.join(unlike.select("table_name", "seq", "card"), ["table_name", "seq"]).where("rec <> card")
        links = links.select(F.concat_ws(":", "table_name", "rec").alias("a"), F.concat_ws(":", "table_name", "card").alias("b")).distinct()
        nodes, stars = connected_components(links, "a", "b")
        df = df.join(nodes, F.concat_ws(":", "table_name", "key") == F.col("node"), "left").withColumn("key", F.coalesce("component", "key"))
        done = save(df.select("table_name", "pos", "key"), "keys")
        stars.drop()
    else:
        done = save(df.select("table_name", "pos", "key"), "keys")
    raw.drop()
    return done


def collapse(keyed: DataFrame, hot_parts: int = 256, salts: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """keyed: (table_name, pos, key), a table that is cheap to read again.  The records (table_name, key, first_pos, copies),
    the hot keys among them, and those hot records by themselves."""
    same = ["table_name", "key"]
    total = keyed.count()
    hot = keyed.groupBy(same).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.lit(total / hot_parts)).select(same)
    hot = keyed.sparkSession.createDataFrame(hot.collect(), keyed.select(same).schema)  # fewer than hot_parts rows
    two = (
        keyed.join(F.broadcast(hot), same, "left_semi")
        .withColumn("salt", F.pmod(F.xxhash64("pos"), F.lit(salts)))
        .groupBy(*same, "salt")
        .agg(F.min("pos").alias("m"), F.count(F.lit(1)).alias("n"))
        .groupBy(same)
        .agg(F.min("m").alias("first_pos"), F.sum("n").alias("copies"))
    )
    one = keyed.join(F.broadcast(hot), same, "left_anti").groupBy(same).agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("copies"))
    return one.unionByName(two), hot, two


def records(rows: DataFrame) -> tuple[DataFrame, Saved]:
    """One row (table_name, first_pos, copies) for each record."""
    keyed = canonical_keys(rows)
    return collapse(keyed.df)[0].select("table_name", "first_pos", "copies"), keyed


def copy_rows(rows: DataFrame) -> tuple[DataFrame, Saved]:
    """(table_name, first_pos, copy_pos), one row for each copy but the first."""
    keyed = canonical_keys(rows)
    same = ["table_name", "key"]
    every, hot, two = collapse(keyed.df)
    several = every.where("copies > 1").select(*same, "first_pos")
    cold = keyed.df.join(F.broadcast(hot), same, "left_anti").join(several, same)
    warm = keyed.df.join(F.broadcast(two.select(*same, "first_pos")), same)
    both = cold.unionByName(warm.select(cold.columns))
    return both.where("pos <> first_pos").select("table_name", "first_pos", F.col("pos").alias("copy_pos")), keyed

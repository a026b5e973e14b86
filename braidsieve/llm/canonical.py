"""Visually identical texts with different characters (problem 4).

Every text gets its plain form and a folded key: compatibility normalisation in composed form, full case folding, white
space mapped and default-ignorable characters removed, computed once for each distinct value of an Arrow batch.  Texts
that look the same share the key and meet by it; of those, texts with one plain form are the same to a reader.

Defined results: null texts and texts without words are in no pair; texts stored alike are no pair; ids may repeat, a row
is never paired with itself.  128-bit digests stand for texts when rows are compared.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidsieve.llm import text as tx
from braidsieve.operators.expand import member_pairs
from braidsieve.llm.topn import unused
from braidsieve.operators.skew import skewed_join
from braidsieve.scratch import Saved, save
from braidsieve.session import spread


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def halves(text: str) -> tuple[int, int]:
    """128 bits of a hash as two signed numbers."""
    d = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _forms(text: str | None) -> dict | None:
    if text is None or not tx.words_of(text):
        return None
    plain = tx.plain_form(text)
    p0, p1 = halves(plain)
    s0, s1 = (p0, p1) if plain == text else halves(text)
    return {"key": xxhash.xxh64_intdigest(tx.fold(plain).encode("utf-8", "surrogatepass")) - (1 << 63), "p0": p0, "p1": p1, "s0": s0, "s1": s1}


_NAMES = ("key", "p0", "p1", "s0", "s1")
_digests = tx.column(_forms, T.StructType([T.StructField(c, T.LongType()) for c in _NAMES]), pa.struct([(c, pa.int64()) for c in _NAMES]))


def canonical_texts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``plain_text`` and ``text_key`` (with an underscore behind where a column has that name already)."""
    names = [unused(c, df.columns) for c in ("plain_text", "text_key")]
    return df.withColumns({names[0]: tx.plain(f"`{text}`"), names[1]: tx.folded(f"`{text}`")})


def look_alike_pairs(rows: DataFrame) -> tuple[DataFrame, Saved]:
    """rows: (table_name, pos, text).  Pairs (table_name, pos_a, pos_b), pos_a < pos_b, of rows of one table whose texts differ
    as stored but not in plain form; and the saved table behind them.

    Rows meet by their folded key.  A key with one stored text only has nothing to pair and leaves by an aggregate; what
    remains is paired by stored text first, where the plain forms are equal, and then carried to the rows, so copies
    stored alike are never compared with each other."""
    kept = save(spread(rows.select("table_name", "pos", "text")).select("table_name", "pos", _digests("text").alias("d")).where("d is not null").select("table_name", "pos", "d.*"), "forms")
    kinds = kept.df.groupBy("table_name", *_NAMES).agg(F.count(F.lit(1)).alias("c"))
    met = kinds.groupBy("table_name", "key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("rows")).where("kinds > 1")
    some = save(skewed_join(kept.df, met, ["table_name", "key"], "rows", kept.rows).select("table_name", "pos", *_NAMES), "some")
    kept.drop()
    kind = ["table_name", "key", "p0", "p1", "s0", "s1"]
    sizes = some.df.groupBy(kind).agg(F.count(F.lit(1)).alias("c"))
    a, b = (sizes.select(*kind[:4], *[F.col(c).alias(f"{c}_{s}") for c in kind[4:]]) for s in "ab")
    links = a.join(b, kind[:4]).where("s0_a < s0_b or (s0_a = s0_b and s1_a < s1_b)")
    links = links.select(*[F.col(c).alias(f"{c}_{s}") for c in ("table_name",) for s in "ab"], "s0_a", "s1_a", "s0_b", "s1_b")
    # a stored text has one plain form and one key, so it names its group by itself
    both = member_pairs(links, some.df, ["table_name", "s0", "s1"], "pos", sizes.select("table_name", "s0", "s1", "c"))
    out = both.select(F.col("table_name_a").alias("table_name"), F.least("pos_a", "pos_b").alias("pos_a"), F.greatest("pos_a", "pos_b").alias("pos_b"))
    return out.where("pos_a < pos_b"), some

"""Ground truth: corrupted items planted in background documents, and untouched controls.

Per spec the first ``items_per_spec`` items to which it applies, in a seeded order, are planted one to a document; the host and
the place are drawn from the record's own stream.  The manifest holds offsets, lengths and digests, no text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from braidsieve.functions.hashing import digest_column, stream, text_digest
from braidsieve.operators.corrupt import Spec, corrupt_all, default_specs
from braidsieve.operators.numbering import numbered
from braidsieve.scratch import save

MANIFEST = ["doc_id", "item_id", "spec", "kind", "intensity", "host_doc_id", "offset", "length", "digest"]


@dataclass
class PlantedCorpus:
    """documents (doc_key, doc_id, text), plants (``MANIFEST``), controls (doc_id), shortfalls (spec, planted)."""

    documents: DataFrame
    plants: DataFrame
    controls: DataFrame
    shortfalls: DataFrame

    def text_of(self, doc_id: str) -> str:
        row = self.documents.where(F.col("doc_id") == doc_id).select("text").first()
        if row is None:
            raise KeyError(doc_id)
        return row[0]


_DRAW = T.StructType([T.StructField("host", T.LongType()), T.StructField("u", T.DoubleType())])


def _draw(seed: int, hosts: int, kind: str):
    @F.arrow_udf(_DRAW)
    def run(key: pa.Array) -> pa.Array:
        drawn = [(r.randrange(hosts), r.random()) for r in (stream(seed, kind, k) for k in key.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([d[0] for d in drawn], pa.int64()), pa.array([d[1] for d in drawn], pa.float64())], ["host", "u"])

    return run


def places(host: str) -> list[int]:
    """Where a text may be planted: paragraph starts, else spaces, and both ends."""
    inner = [m.end() for m in re.finditer(r"\n\n+", host)] or [m.start() for m in re.finditer(" ", host)]
    return sorted({0, *inner, len(host)})


def trimmed(text: str, most: int) -> str:
    """A host cut to at most ``most`` characters, at its last space if there is one past the start."""
    if len(text) <= most:
        return text
    head = text[:most]
    return head.rpartition(" ")[0] or head


def _trim(most: int):
    @F.arrow_udf(T.StringType())
    def run(host: pa.Array) -> pa.Array:
        return pa.array([trimmed(h, most) for h in host.to_pylist()], pa.string())

    return run


_SET = T.StructType([T.StructField("text", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("digest", T.StringType())])


def _set_in(most: int):
    @F.arrow_udf(_SET)
    def run(host: pa.Array, planted: pa.Array, u: pa.Array) -> pa.Array:
        out = []
        for h, p, x in zip(host.to_pylist(), planted.to_pylist(), u.to_pylist()):
            h = trimmed(h, most)
            at = places(h)
            o = at[int(x * len(at))]
            out.append((f"{h[:o]}\n\n{p}\n\n{h[o:]}", o + 2, text_digest(p)))
        return pa.StructArray.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string())], _SET.names)

    return run


def plant(items: DataFrame, background: DataFrame, specs: list[Spec] | None = None, *, items_per_spec: int = 100, controls: int = 500, seed: int = 0, max_host_chars: int = 4000) -> PlantedCorpus:
    """The planted corpus, saved.  Errors: no items, repeated item ids, repeated labels, no usable host."""
    specs = default_specs() if specs is None else specs
    if items_per_spec < 1 or controls < 0:
        raise ValueError("items_per_spec must be at least 1 and controls at least 0")
    if len({s.label for s in specs}) < len(specs):
        raise ValueError("spec labels must be unique")
    n, ids = items.agg(F.count(F.lit(1)), F.count_distinct("item_id")).first()
    if n == 0:
        raise ValueError("no items to plant")
    if n != ids:
        raise ValueError("item ids must be unique")
    usable = background.where("text rlike '(?U)\\\\S'").select("doc_key", "doc_id", "text")
    hosts = save(usable.join(numbered(usable, "doc_key"), "doc_key").select(F.col("number").alias("host"), F.col("doc_id").alias("host_doc_id"), F.col("text").alias("host_text")), "hosts").df
    count = hosts.count()
    if count == 0:
        raise ValueError("the background has no usable document")

    order = W.Window.partitionBy("spec").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "spec", "item_id"), "item_id")
    chosen = corrupt_all(items, specs, seed).withColumn("n", F.row_number().over(order)).where(F.col("n") <= items_per_spec)
    drawn = chosen.withColumn("d", _draw(seed, count, "place")(F.concat_ws("|", "spec", "item_id"))).select("item_id", "spec", "kind", "intensity", "planted", "d.*")
    placed = drawn.join(hosts, "host").withColumn("s", _set_in(max_host_chars)("host_text", "planted", "u"))
    made = save(
        placed.select(
            F.concat_ws(":", F.lit("plant"), "spec", "item_id").alias("doc_id"), "item_id", "spec", "kind", "intensity", "host_doc_id",
            "s.offset", F.length("planted").alias("length"), "s.digest", "s.text",
        ), "planted",
    ).df
    range_ = items.sparkSession.range(controls).select(F.concat(F.lit("control:"), F.col("id").cast("string")).alias("doc_id"), F.col("id").cast("string").alias("key"))
    control = range_.withColumn("d", _draw(seed, count, "control")("key")).select("doc_id", "d.host").join(hosts, "host")
    cut = control.select("doc_id", _trim(max_host_chars)("host_text").alias("text"))
    documents = save(made.select("doc_id", "text").unionByName(cut).select(F.col("doc_id").alias("doc_key"), "doc_id", "text"), "corpus").df
    labels = items.sparkSession.createDataFrame([(s.label,) for s in specs], "spec string")
    short = labels.join(made.groupBy("spec").agg(F.count(F.lit(1)).alias("planted")), "spec", "left").na.fill(0).where(F.col("planted") < items_per_spec)
    return PlantedCorpus(documents, made.select(MANIFEST), documents.where("doc_id like 'control:%'").select("doc_id"), short)


def verify(corpus: PlantedCorpus) -> DataFrame:
    """(doc_id, problem) of plants that do not stand where the manifest says; empty if all do."""
    both = corpus.plants.join(corpus.documents.select("doc_id", "text"), "doc_id", "left")
    there = F.substring("text", F.col("offset") + 1, F.col("length"))
    wrong = (F.length(there) != F.col("length")) | (digest_column(there) != F.col("digest"))
    problem = F.when(F.col("text").isNull(), "document missing").when(wrong, "text does not match the digest")
    return both.select("doc_id", problem.alias("problem")).where("problem is not null")

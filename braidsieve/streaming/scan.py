"""A scan that follows a growing folder of documents, with exactly-once results.

Structured Streaming reads new files; every micro-batch runs the batch plan without state and overwrites its own folder
``hits/batch=N``, so a batch that is run again after a crash replaces what it left.  Beside the checkpoint lie the
fingerprint of the settings and a record of each batch; a resume with other settings or items, or with a batch that is
lost or short, is refused.  All files are reached through Hadoop's file systems, so the folder may be on any shared store.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsieve.functions.text import token_count, token_line
from braidsieve.operators.containment import Thresholds, build_index, scan
from braidsieve.operators.items import QUESTION_CHOICES, benchmark_of, view_text
from braidsieve.scratch import scope
from braidsieve.sources.files import HITS, exists, names, read_json, remove, write_json


class ScanError(Exception):
    """A scan cannot start or go on safely."""


@dataclass(frozen=True)
class ScanConfig:
    n: int = 3
    view: str = QUESTION_CHOICES
    partial: float = 0.5
    near_duplicate: float = 0.9
    window_slack: float | None = 1.5
    stop_ngram_k: int | None = None
    min_tokens: int | None = None
    snippet_chars: int = 200
    files_per_batch: int = 16
    source: str = ""


TOTALS = ("documents", "tokens", "hits", "malformed")


def fingerprint(items: DataFrame, config: ScanConfig) -> dict:
    """Settings that affect results, and an order-free digest of the items."""
    rows = items.select(F.sha2(F.concat_ws("\x00", "item_id", view_text(config.view)), 256).alias("h"))
    n, x = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0))).first()
    digest = hashlib.sha256(f"{n}|{x}".encode()).hexdigest()
    return {k: v for k, v in asdict(config).items() if k != "files_per_batch"} | {"items": n, "items_digest": digest}


def progress(spark: SparkSession, out_dir: str) -> dict:
    """documents, tokens, hits, malformed, batches and finished of a scan, from its batches' records."""
    done = [read_json(spark, f"{out_dir}/batches/{n}") for n in names(spark, f"{out_dir}/batches")]
    return {k: sum(d[k] for d in done) for k in TOTALS} | {"batches": len(done), "finished": read_json(spark, f"{out_dir}/state.json")["finished"]}


def _check_batches(spark: SparkSession, out_dir: str) -> None:
    """Every committed batch must have its record and as many hits as it says."""
    known = set(names(spark, f"{out_dir}/batches"))
    for n in names(spark, f"{out_dir}/checkpoint/commits"):
        if f"{n}.json" not in known:
            raise ScanError(f"the record of batch {n} is lost; overwrite the scan")
    for name in sorted(known):
        folder = f"{out_dir}/hits/batch={name.removesuffix('.json')}"
        rows = spark.read.schema("item_id string").parquet(folder).count() if exists(spark, folder) else None
        if rows != read_json(spark, f"{out_dir}/batches/{name}")["hits"]:
            raise ScanError(f"the hits of batch {name.removesuffix('.json')} are lost or not all there; overwrite the scan")


def run_scan(
    spark: SparkSession, items: DataFrame, documents_dir: str, schema: str, out_dir: str, config: ScanConfig, *, as_documents: Callable[[DataFrame], DataFrame], format: str = "parquet",
    resume: bool = False, overwrite: bool = False, on_batch: Callable[[dict], None] | None = None,
) -> dict:
    """Scan every file of ``documents_dir``, or that one file (parquet, or JSON Lines as ``json``), not scanned yet; its ``progress``.  After each
    batch ``on_batch`` gets the batch's record."""
    out = out_dir.rstrip("/")
    state, batches, hits_dir, checkpoint = f"{out}/state.json", f"{out}/batches", f"{out}/hits", f"{out}/checkpoint"
    mark = fingerprint(items, config)
    if overwrite:
        for p in (state, batches, hits_dir, checkpoint):
            remove(spark, p)
    elif exists(spark, state):
        if not resume:
            raise ScanError("a scan was begun here; resume it or overwrite it")
        if read_json(spark, state)["fingerprint"] != json.loads(json.dumps(mark)):
            raise ScanError("the scan was begun with other settings or items")
        _check_batches(spark, out)
    elif exists(spark, hits_dir):
        raise ScanError("there are hits without a state; overwrite them")
    write_json(spark, state, {"fingerprint": mark, "finished": False})

    with scope():
        index = build_index(items, view=config.view, n=config.n, stop_k=config.stop_ngram_k, min_tokens=config.min_tokens)
        by = {r[0]: r[1] for r in items.groupBy(benchmark_of(F.col("item_id"))).count().collect()}  # a row for each benchmark
        indexed = {r[0]: r[1] for r in index.item_ids().groupBy(benchmark_of(F.col("item_id"))).count().collect()}
        index.skipped.coalesce(1).write.mode("overwrite").json(f"{out}/skipped")
        write_json(spark, f"{out}/scan.json", {"fingerprint": mark, "items_by_benchmark": by, "indexed_by_benchmark": indexed, "summary": index.summary().first().asDict()})

        def one(batch: DataFrame, number: int) -> None:
            with scope():
                docs = as_documents(batch)
                target = f"{hits_dir}/batch={number}"
                found = scan(docs, index, Thresholds(config.partial, config.near_duplicate), window_slack=config.window_slack, snippet_chars=config.snippet_chars)
                found.write.mode("overwrite").parquet(target)
                totals = docs.agg(F.count("text").alias("documents"), F.coalesce(F.sum(token_count(token_line("text"))), F.lit(0)).alias("tokens"), F.count_if(F.col("text").isNull()).alias("malformed"))
                record = totals.first().asDict() | {"batch": number, "hits": spark.read.parquet(target).count()}
            write_json(spark, f"{batches}/{number}.json", record)
            if on_batch is not None:
                on_batch(record)

        stream = spark.readStream.schema(schema).format(format).option("mode", "FAILFAST").option("maxFilesPerTrigger", config.files_per_batch)
        place, _, file = documents_dir.rstrip("/").rpartition("/")
        # a stream follows a folder or a pattern; a single file is named by a pattern that only it fits
        stream = stream.load(f"{place}/{file[:-1]}[{file[-1]}]" if names(spark, documents_dir) == [file] else documents_dir)
        stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    write_json(spark, state, {"fingerprint": mark, "finished": True})
    return progress(spark, out)


def scan_hits(spark: SparkSession, out_dir: str) -> DataFrame:
    """The hits of a scan, finished or not; none before its first batch."""
    if not names(spark, f"{out_dir}/hits"):
        return spark.createDataFrame([], f"{HITS}, doc_key string")
    return spark.read.parquet(f"{out_dir}/hits").drop("batch")

"""Results on disk: hits, manifests of plants, tables as CSV, small JSON files, and the record of a run."""

from __future__ import annotations

import json
import platform
import sys
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsieve import __version__
from braidsieve.operators.plant import MANIFEST
from braidsieve.sources.jsonl import read_jsonl, write_jsonl

HITS = "item_id string, doc_id string, level string, containment double, matched_ngrams int, total_ngrams int, ngram_size int, exact boolean, short boolean, window_start int, snippet string"
PLANTS = "doc_id string, item_id string, spec string, kind string, intensity double, host_doc_id string, offset int, length int, digest string"


def hit_records(hits: DataFrame) -> DataFrame:
    """Hits as they are written: containment rounded half-even to four places."""
    names = [part.split()[0] for part in HITS.split(", ")]
    return hits.withColumn("containment", F.bround("containment", 4)).select(names)


def write_hits(hits: DataFrame, path: str, mode: str = "errorifexists") -> int:
    return write_jsonl(hit_records(hits), path, mode)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, HITS)


def write_manifest(plants: DataFrame, path: str) -> int:
    return write_jsonl(plants.select(MANIFEST), path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, PLANTS)


def write_csv(df: DataFrame, path: str) -> None:
    """A table with a header line."""
    df.write.option("header", True).mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a header line; a byte-order mark before it does no harm."""
    return spark.read.option("header", True).option("enforceSchema", True).option("multiLine", True).schema(schema).csv(path)


def _place(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _place(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing happens if there is none."""
    fs, p = _place(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names within a folder, hidden ones left out; none if there is no folder."""
    fs, p = _place(spark, path)
    found = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in found if not n.startswith((".", "_")))


def write_json(spark: SparkSession, path: str, content: dict[str, Any]) -> None:
    """One small JSON file on any file system Spark reaches, in place at once or not at all."""
    fs, p = _place(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(new, True)
    out.write(bytearray((json.dumps(content, indent=2, sort_keys=True, default=str) + "\n").encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, p, over)


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    fs, p = _place(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current_commit(start: str | Path = ".") -> str | None:
    """The commit that is checked out, read from the folder's files; null outside of a repository."""
    here = Path(start).resolve()
    home = next((d / ".git" for d in (here, *here.parents) if (d / ".git").is_dir()), None)
    if home is None:
        return None
    try:
        head = (home / "HEAD").read_text().strip()
        name = head.removeprefix("ref: ")
        if name == head:
            return head
        if (home / name).is_file():
            return (home / name).read_text().strip()
        packed = (home / "packed-refs").read_text().splitlines()
    except OSError:
        return None
    return next((line.split()[0] for line in packed if line.split()[1:] == [name]), None)


def run_record(config: dict[str, Any], **extra: Any) -> dict[str, Any]:
    """What is needed to repeat a run."""
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    return {"version": __version__, "python": platform.python_version(), "platform": sys.platform, "at": now, "commit": current_commit(), "config": config} | ({"extra": extra} if extra else {})

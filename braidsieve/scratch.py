"""Cut lineage with tables in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``, or the checkpoint directory of its context.  A local session without
either gets a temporary folder of this machine; on a cluster that is an error, since executors would write where nobody
else reads.  Tables are written as parquet, so losing an executor costs nothing that was saved.  A table is deleted when
its owner drops it, at the end of the ``scope`` it was saved in, or at the end of the driver's process.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_live: dict[str, SparkSession] = {}
_scopes: list[list[Saved]] = []
_own: str | None = None


def folder(spark: SparkSession) -> str:
    """The shared folder; raises where a cluster names none."""
    global _own
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="braidsieve-")
    return f"file://{_own}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_live.items()):
        with contextlib.suppress(Exception):
            _delete(spark, path)


class Saved:
    """A table written once: ``df`` reads it, ``rows`` is its number of rows, ``drop()`` deletes it."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, rows: int) -> None:
        self.spark, self.path, self.schema, self.rows = spark, path, schema, rows

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        if _live.pop(self.path, None) is not None:
            _delete(self.spark, self.path)


def save(df: DataFrame, tag: str) -> Saved:
    """Write ``df`` to the shared folder; its rows are counted while they are written."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    _live[path] = spark
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    made = Saved(spark, path, df.schema, seen.get["rows"])
    if _scopes:
        _scopes[-1].append(made)
    return made


@contextlib.contextmanager
def scope() -> Iterator[list[Saved]]:
    """Tables saved within are dropped at the end."""
    made: list[Saved] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.pop()
        for s in made:
            s.drop()


def owned(query: Callable[[], DataFrame]) -> DataFrame:
    """The query's result, without the tables it saved: if any are left, the result is checkpointed in the shared folder (where
    Spark deletes it once it is no longer used, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set) and they
    are dropped."""
    with scope() as made:
        df = query()
        if any(s.path in _live for s in made):
            sc = df.sparkSession.sparkContext
            if sc.getCheckpointDir() is None:
                sc.setCheckpointDir(folder(df.sparkSession))
            df = df.checkpoint()
        return df

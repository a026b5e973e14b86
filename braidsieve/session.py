"""Sessions: local ones for tests and benchmarks, and the package's own code on a cluster's workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package; does nothing the second time for one application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    file = os.path.join(tempfile.mkdtemp(prefix="braidsieve-code-"), "braidsieve.zip")
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(file)
    _shipped.add(sc.applicationId)


def local(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with settings for small machines."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("braidsieve")
    own = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": "8g",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    spark = b.config(map=own | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def spread(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """``df`` over all cores, if the scan of its source (``like``, or itself) has splits for less than half of them, as with
    one small file; a table of many splits is left as it is and not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = (df if like is None else like)._jdf.queryExecution().toRdd().getNumPartitions()
    return df if 2 * splits >= cores else df.repartition(cores)

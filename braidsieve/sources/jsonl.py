"""JSON Lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON Lines file or folder; blank lines are skipped.  A line that is no JSON object fails the query when it is
    read, naming the file and the line's first characters.  A field that is missing and one that is null are both null."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    bad = "_bad_line"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^\\x{FEFF}", "")).alias("value"), F.col("_metadata.file_path").alias("file")).where("length(value) > 0")
    parsed = lines.select("value", "file", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    wrong = F.col("r").isNull() | F.col(f"r.{bad}").isNotNull() | ~F.startswith("value", F.lit("{"))
    ok = F.when(wrong, F.raise_error(F.concat("file", F.lit(": invalid JSON object: "), F.substring("value", 1, 80))).cast(schema)).otherwise(F.struct(*[F.col(f"r.{f.name}").alias(f.name) for f in schema]))
    return parsed.select(ok.alias("r")).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema])


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write rows as JSON Lines (UTF-8, characters as they are, nulls kept); the number of rows, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return seen.get["rows"]

"""The driver's contract: queries and SQL have the same names, columns and rows."""

from __future__ import annotations

import math
import os
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry_point

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_is_its_sql(spark, db, name):
    df = entry_point.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    found = db.sql(entry_point.oracle_sql()[name])
    assert sorted(found.columns) == names
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    at = [found.columns.index(c) for c in names]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


@needs_data
def test_entry(spark):
    assert entry_point.entry(spark).columns


@needs_data
def test_a_query_leaves_no_table_behind(spark):
    from braidsieve import scratch

    home = Path(scratch.folder(spark).removeprefix("file://"))
    before = {p.name for p in home.iterdir()}
    for name in ("hits_question", "near_dup_items", "token_budget"):
        df = entry_point.queries()[name](spark, str(DATA))
        assert df.collect() == df.collect()
        left = [p for p in home.iterdir() if p.name not in before]
        assert not [p for p in left if list(p.glob("*.parquet"))], name


def test_a_cluster_must_name_its_folder():
    from types import SimpleNamespace as N

    from braidsieve import scratch

    def session(master, named=None, of_context=None):
        return N(sparkContext=N(getConf=lambda: {"spark.checkpoint.dir": named}, getCheckpointDir=lambda: of_context, master=master))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.folder(session("spark://host:7077"))
    assert scratch.folder(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y" and scratch.folder(session("yarn", None, "hdfs://z")) == "hdfs://z"
    assert scratch.folder(session("local[2]")).startswith("file://")

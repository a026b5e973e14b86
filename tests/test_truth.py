"""Corruptions, planting, evaluation, fuzzy scans and the streaming scan."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from braidsieve.functions.text import tokens_of
from braidsieve.operators import corrupt, evaluate, fuzzy, plant
from braidsieve.operators.compare import compare_methods
from braidsieve.operators.items import QUESTION, QUESTION_CHOICES, corpus
from braidsieve.sources import synthetic


@pytest.fixture(scope="module")
def items(spark):
    df = synthetic.items(spark, 60, 1).cache()
    assert df.select("item_id").distinct().count() == 60
    return df


@pytest.fixture(scope="module")
def background(spark):
    return synthetic.background(spark, 40, 1).cache()


SPECS = [corrupt.Spec("verbatim"), corrupt.Spec("word_delete", 0.3), corrupt.Spec("format_noise")]


@pytest.fixture(scope="module")
def planted(items, background):
    return plant.plant(items, background, SPECS, items_per_spec=10, controls=8, seed=5)


def test_specs():
    assert [s.label for s in corrupt.default_specs()][3:5] == ["word_delete@0.05", "word_delete@0.1"] and len(corrupt.default_specs()) == 20
    for kind, x in (("word_delete", None), ("truncate", 1.2), ("html_split", 0.5), ("html_split", 1.5), ("unknown", None)):
        with pytest.raises(ValueError):
            corrupt.Spec(kind, x)


def test_corruptions(spark, items):
    rows = {(r["item_id"], r["spec"]): r["planted"] for r in corrupt.corrupt_all(items, corrupt.default_specs()).collect()}
    again = {(r["item_id"], r["spec"]): r["planted"] for r in corrupt.corrupt_all(items.repartition(5), corrupt.default_specs()[::-1]).collect()}
    assert rows == again
    for r in items.collect():
        i, text = r["item_id"], "\n".join([r["question"], *r["choices"]])
        words = text.split()
        assert rows[i, "verbatim"] == text
        assert tokens_of(rows[i, "format_noise"]) == tokens_of(text)
        assert rows[i, "truncate@0.6"].split() == words[: max(1, round(0.6 * len(words)))] and text.startswith(rows[i, "truncate@0.6"])
        assert 0 < len(rows[i, "word_delete@0.3"].split()) <= len(words) == len(rows[i, "word_substitute@0.3"].split())
        old, new = re.findall(r"\d+", text), re.findall(r"\d+", rows[i, "number_change"])
        assert old != new and [len(x) for x in old] == [len(x) for x in new]
        assert rows[i, "html_split@3"].count("<br />") == 3 and rows[i, "html_split@3"].replace("\n<br />\n", "") == text
        assert text in rows[i, "html_wrap"]
        for spec in ("choice_shuffle", "labelled_dot", "labelled_paren"):
            assert ((i, spec) in rows) == bool(r["choices"])
        if r["choices"]:
            assert rows[i, "labelled_paren"].splitlines()[2].startswith("(B) ") and rows[i, "labelled_dot"].splitlines()[1].startswith("A. ")
            shuffled = rows[i, "choice_shuffle"].splitlines()
            assert shuffled[1:] != r["choices"] and sorted(shuffled[1:]) == sorted(r["choices"])
    bare = spark.createDataFrame([("x", "no marks here", [])], "item_id string, question string, choices array<string>")
    assert {r["spec"] for r in corrupt.corrupt_all(bare, [corrupt.Spec("punct_delete"), corrupt.Spec("number_change"), corrupt.Spec("verbatim")]).collect()} == {"verbatim"}


def test_planting(spark, items, background, planted):
    assert planted.plants.count() == 30 and planted.controls.count() == 8 and planted.documents.count() == 38
    assert plant.verify(planted).count() == 0
    row = planted.plants.where("spec = 'verbatim'").first()
    text = planted.text_of(row["doc_id"])
    item = items.where(F.col("item_id") == row["item_id"]).first()
    assert text[row["offset"] : row["offset"] + row["length"]] == "\n".join([item["question"], *item["choices"]])
    with pytest.raises(KeyError):
        planted.text_of("no such")
    broken = plant.PlantedCorpus(planted.documents.where(f"doc_id <> '{row['doc_id']}'"), planted.plants.withColumn("digest", F.when(F.col("kind") == "format_noise", "0").otherwise(F.col("digest"))), planted.controls, planted.shortfalls)
    assert plant.verify(broken).count() == 11
    again = plant.plant(items.repartition(3), background.repartition(7), SPECS[::-1], items_per_spec=10, controls=8, seed=5)
    assert sorted(map(tuple, again.plants.collect())) == sorted(map(tuple, planted.plants.collect()))
    short = plant.plant(items, background, [corrupt.Spec("choice_shuffle")], items_per_spec=100, controls=0)
    assert short.shortfalls.first()["planted"] == items.where("size(choices) > 0").count()
    for bad in ({"items_per_spec": 0}, {"controls": -1}, {"specs": [SPECS[0], SPECS[0]]}):
        with pytest.raises(ValueError):
            plant.plant(items, background, **bad)
    with pytest.raises(ValueError):
        plant.plant(items, background.limit(0))
    assert plant.trimmed("ab cd ef", 6) == "ab cd" and plant.trimmed("abcdef", 3) == "abc" and plant.places("a\n\nb") == [0, 3, 4] and plant.places("a b") == [0, 1, 3]


def test_evaluation(items, planted):
    rows = evaluate.sweep(items, planted, ns=(3, 5), views=(QUESTION_CHOICES,), partials=(0.3, 0.9), near_duplicates=(0.8,), window_slacks=(None, 1.5))
    found = rows.collect()
    assert len(found) == 2 * 2 * 3 and all(r["control_flagged"] == 0 and r["foreign_hits"] == 0 and r["planted"] == 10 for r in found)
    at = {(r["n"], r["window_slack"], r["spec"]): r for r in found}
    for n in (3, 5):
        for slack in (None, 1.5):
            assert at[n, slack, "verbatim"]["recall"] == 1.0 and at[n, slack, "verbatim"]["exact"] == 10 and at[n, slack, "format_noise"]["exact"] == 10
            assert at[n, slack, "word_delete@0.3"]["mean_containment"] < 0.9
    assert at[3, None, "word_delete@0.3"]["mean_containment"] > at[5, None, "word_delete@0.3"]["mean_containment"]
    point = evaluate.select_point(rows, view=QUESTION_CHOICES, max_control_fpr_upper=0.5)
    assert point.n == 3 and point.window_slack is None
    with pytest.raises(ValueError):
        evaluate.select_point(rows, view=QUESTION, max_control_fpr_upper=0.5)
    with pytest.raises(ValueError):
        evaluate.select_point(rows, view=QUESTION_CHOICES, max_control_fpr_upper=0.01)
    assert evaluate.OperatingPoint.from_json(point.to_json()) == point
    summary = evaluate.evaluate_at(items, planted, point)
    assert summary.count() == 3 and evaluate.macro_recall(summary).first()["macro_recall"] == pytest.approx(point.macro_recall)


def test_fuzzy_and_comparison(spark, items, planted):
    out = {(r["item_id"], r["doc_id"]): r for r in fuzzy.fuzzy_scan(planted.documents, items, view=QUESTION_CHOICES).collect()}
    for r in planted.plants.collect():
        if r["kind"] != "word_delete":
            # windows start at every eighth of their length, so up to an eighth of a copy may lie outside
            assert out[r["item_id"], r["doc_id"]]["containment"] >= 0.85
    assert not any(d.startswith("control") for _, d in out)
    blocks = fuzzy.fuzzy_scan(planted.documents, items, view=QUESTION_CHOICES, block_shingles=300)
    assert {(r["item_id"], r["doc_id"]) for r in blocks.collect()} == set(out)
    with pytest.raises(ValueError):
        fuzzy.fuzzy_scan(planted.documents, items, hashes=64, bands=30)
    table = compare_methods(items, planted, ns=(3,), windowed=((3, 1.5),), fuzzy_ks=(2,), view=QUESTION_CHOICES)
    rows = {(r["method"], r["spec"]): r for r in table.collect()}
    assert len(rows) == 9 and all(r["recall"] == 1.0 for (_, spec), r in rows.items() if spec == "verbatim") and all(r["seconds"] > 0 for r in rows.values())


def test_streaming(spark, items, planted, tmp_path):
    from braidsieve.operators.containment import Thresholds, build_index, scan
    from braidsieve.streaming.scan import ScanConfig, ScanError, progress, run_scan, scan_hits

    docs = planted.documents.select("doc_id", "text").unionByName(spark.createDataFrame([("bad", None)], "doc_id string, text string"))
    docs.repartition(6).write.parquet(str(tmp_path / "docs"))
    config = ScanConfig(n=3, files_per_batch=2)

    def run(settings=config, **how):
        return run_scan(spark, items, str(tmp_path / "docs"), "doc_id string, text string", str(tmp_path / "out"), settings, as_documents=lambda df: corpus(df, "doc_id", "doc_id"), **how)

    calls = []

    def breaks(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("a batch breaks off")
        return corpus(df, "doc_id", "doc_id")

    where = (str(tmp_path / "docs"), "doc_id string, text string", str(tmp_path / "out"), config)
    with pytest.raises(Exception, match="breaks off"):
        run_scan(spark, items, *where, as_documents=breaks)
    state = progress(spark, str(tmp_path / "out"))
    assert state["batches"] == 1 and not state["finished"]
    seen = []
    first = run(resume=True, on_batch=seen.append)
    assert [r["batch"] for r in seen] == [1, 2] and first["tokens"] > 0
    want = scan(corpus(docs, "doc_id", "doc_id"), build_index(items, n=3), Thresholds(0.5, 0.9), window_slack=1.5, snippet_chars=200)
    assert sorted(map(tuple, scan_hits(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))
    assert first["documents"] == 38 and first["malformed"] == 1 and first["batches"] == 3 and first["hits"] == want.count()
    with pytest.raises(ScanError):
        run()
    with pytest.raises(ScanError):
        run(ScanConfig(n=4), resume=True)
    assert run(resume=True) == first
    docs.limit(3).withColumn("doc_id", F.concat(F.lit("new"), "doc_id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    more = run(resume=True)
    batch = tmp_path / "out/hits/batch=0"
    kept = {p.name: p.read_bytes() for p in batch.iterdir() if p.suffix == ".parquet" or p.name.endswith(".crc")}
    for p in batch.iterdir():
        p.unlink()
    with pytest.raises(ScanError, match="batch 0"):
        run(resume=True)
    batch.rmdir()
    with pytest.raises(ScanError, match="batch 0"):
        run(resume=True)
    batch.mkdir()
    for name, data in kept.items():
        (batch / name).write_bytes(data)
    record = tmp_path / "out/batches/0.json"
    text = record.read_bytes()
    record.unlink()
    with pytest.raises(ScanError, match="record of batch 0"):
        run(resume=True)
    record.write_bytes(text)
    assert run(resume=True) == more
    assert more["batches"] == 4 and more["documents"] + more["malformed"] == 42
    assert run(overwrite=True)["documents"] == more["documents"]

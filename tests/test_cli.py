"""The command line and the experiment, end to end on generated data."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from braidsieve import cli, plots
from braidsieve.experiment import Experiment, run_experiment
from braidsieve.operators import evaluate
from braidsieve.operators.corrupt import Spec
from braidsieve.sources import synthetic
from braidsieve.sources.files import read_csv, read_manifest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("cli")
    synthetic.items(spark, 40, 2).write.parquet(str(home / "items"))
    items = spark.read.parquet(str(home / "items"))
    docs = synthetic.background(spark, 20, 2).select("doc_id", "text")
    docs.unionByName(items.limit(3).selectExpr("concat('copy of ', item_id) doc_id", "concat_ws('\n', question, choices) text")).repartition(4).write.parquet(str(home / "docs"))
    with (home / "docs.jsonl").open("w") as f:
        for i, r in enumerate(spark.read.parquet(str(home / "docs")).orderBy("doc_id").collect()):
            f.write(json.dumps({"id": r["doc_id"], "text": r["text"], "at": i, "token_count": 10}) + "\n")
    with (home / "few.jsonl").open("w") as f:
        for r in items.orderBy("item_id").limit(8).collect():
            f.write(json.dumps({"item_id": "few:" + r["item_id"], "question": r["question"].upper()}) + "\n")
    return home


def test_scan_and_report(folder, capsys):
    scan = ["scan", "--items", f"{folder}/items", "--documents", f"{folder}/docs", "--id", "doc_id", "--out", f"{folder}/scan", "--n", "4"]
    assert cli.main(scan) == 0 and cli.main(scan) == 2
    assert "resume" in capsys.readouterr().err
    assert cli.main([*scan, "--resume"]) == 0
    capsys.readouterr()
    assert cli.main(["report", "--items", f"{folder}/items", "--scan", f"{folder}/scan"]) == 0
    out = capsys.readouterr().out
    assert out.count("EXACT") == 3 and "generated" in out and out.startswith("scan finished: 23 documents") and "items not searched: 0" in out
    assert cli.main(["report", "--items", f"{folder}/items", "--scan", f"{folder}/nothing"]) == 2
    assert cli.main(["scan", "--documents", f"{folder}/docs", "--out", f"{folder}/x"]) == 2 and "--items" in capsys.readouterr().err


def test_scan_of_json_lines_within_a_budget(folder, capsys):
    scan = ["scan", "--items", f"{folder}/items", "--documents", f"{folder}/docs.jsonl", "--format", "jsonl", "--key", "at", "--tokens", "token_count", "--no-window"]
    for flags, docs, found in (([], 23, 3), (["--max-docs", "2"], 2, 2), (["--max-tokens", "11"], 2, 2), (["--max-tokens", "0"], 0, 0), (["--max-docs", "9", "--max-tokens", "5"], 1, 1)):
        assert cli.main([*scan, "--out", f"{folder}/json", "--overwrite", *flags]) == 0
        out = capsys.readouterr().out
        assert f"scan finished: {docs} documents, " in out and out.count("EXACT") == found
    assert cli.main([*scan[:7], "--out", f"{folder}/y", "--max-tokens", "5"]) == 2


def test_demo(folder, capsys):
    assert cli.main(["scan", "--demo", "--demo-items", "12", "--demo-docs", "15", "--out", f"{folder}/demo"]) == 0
    out = capsys.readouterr().out
    assert "EXACT" in out and "scan finished" in out


def test_settings(tmp_path):
    flags = ["scan", "--items", "i", "--documents", "d", "--out", "o"]
    point = evaluate.OperatingPoint.from_json(json.dumps({"n": 5, "stop_ngram_k": 7, "view": "question", "partial": 0.4, "near_duplicate": 0.8, "macro_recall": 1.0, "control_fpr_upper": 0.0, "context": {}}))

    def settings(*more):
        return cli.settings(cli.parser().parse_args([*flags, *more]), point)

    config = settings("--partial", "0.6")
    assert (config.n, config.stop_ngram_k, config.partial, config.window_slack, config.view) == (5, 7, 0.6, None, "question")
    assert settings("--window-slack", "2").window_slack == 2 and settings("--window-slack", "2", "--no-window").window_slack is None
    plain = cli.settings(cli.parser().parse_args(flags))
    assert (plain.n, plain.window_slack, plain.near_duplicate) == (3, 1.5, 0.9)


def test_dupes(folder, capsys):
    assert cli.main(["dupes", "--items", f"{folder}/items"]) == 0
    assert "pairs: 0; at 0.5: 0; at 0.7: 0; at 0.9: 0" in capsys.readouterr().out
    assert cli.main(["dupes", "--items", f"{folder}/items", "--other", f"{folder}/few.jsonl", "--threshold", "0.7", "--show", "2", "--out", f"{folder}/pairs"]) == 0
    out = capsys.readouterr().out
    assert "pairs: 8; at 0.7: 8; at 0.9: 8" in out and out.count("1.00  generated:") == 2
    assert cli.main(["dupes", "--items", f"{folder}/items", "--threshold", "2"]) == 2


SMALL = Experiment(
    grid={"ns": (3,), "partials": (0.5,), "near_duplicates": (0.9,)}, truth={"items_per_spec": 8, "controls": 30, "specs": [Spec("verbatim"), Spec("format_noise"), Spec("word_delete", 0.2)]}, control_bound=0.2, seed=21
)


def test_experiment(spark, folder):
    items, background = spark.read.parquet(f"{folder}/items"), synthetic.background(spark, 30, 3)
    home = folder / "experiment"
    found = run_experiment(items, background, str(home), SMALL)
    rows = {r["spec"]: r for r in found.summary.collect()}
    assert found.point.n == 3 and rows["verbatim"]["recall"] == rows["format_noise"]["recall"] == 1.0 and rows["verbatim"]["control_flagged"] == 0
    for name in ("dev/sweep", "dev/plants", "point.json", "test/conditions", "test/plants", "test/summary.json", "test/sweep", "record.json"):
        assert (home / name).exists()
    saved = json.loads((home / "point.json").read_text())
    summary = json.loads((home / "test/summary.json").read_text())
    assert evaluate.OperatingPoint.from_record(saved) == found.point and saved["context"]["chosen_on"] == "dev"
    assert summary["thresholds"] == {"partial": found.point.partial, "near_duplicate": found.point.near_duplicate} and len(summary["conditions"]) == 3 and 0 < summary["macro_recall"] <= 1
    plants = {side: read_manifest(spark, str(home / side / "plants")).collect() for side in ("dev", "test")}
    for column in ("item_id", "host_doc_id"):
        assert plants["dev"] and {r[column] for r in plants["dev"]}.isdisjoint(r[column] for r in plants["test"])
    again = run_experiment(items.repartition(3), background, str(folder / "again"), SMALL)
    assert again.point == found.point and sorted(map(str, again.summary.collect())) == sorted(map(str, found.summary.collect()))
    with pytest.raises(ValueError, match="provide more items"):
        run_experiment(items.limit(1), background, str(folder / "few"), SMALL)
    table = plots.edit_rate_table(read_csv(spark, str(home / "dev/sweep"), evaluate.SWEEP_SCHEMA), view=found.point.view, partial=0.5, near_duplicate=0.9)
    assert [(r["kind"], r["n"], r["intensity"]) for r in table.collect()] == [("word_delete", 3, 0.2)]
    if plots.available():
        assert (home / "charts/test_recalls.png").exists()
    else:
        with pytest.raises(RuntimeError):
            plots.recall_chart(found.summary)


def test_evaluate_and_compare(folder, capsys):
    some = ["--items", f"{folder}/items", "--background", f"{folder}/docs", "--id", "doc_id", "--items-per-spec", "3", "--controls", "20"]
    assert cli.main(["evaluate", *some, "--out", f"{folder}/e", "--ns", "3", "--stop-ks", "9", "--control-bound", "0.9", "--no-test-sweep", "--no-charts"]) == 0
    assert "macro recall on test" in capsys.readouterr().out and not (folder / "e/test/sweep").exists()
    assert cli.main(["evaluate", *some, "--out", f"{folder}/e2", "--ns", "3", "--control-bound", "0.0001", "--no-test-sweep"]) == 2
    assert cli.main(["compare", *some, "--out", f"{folder}/c", "--ns", "3", "--windowed-ns", "--fuzzy-ks", "2", "--hashes", "32", "--bands", "16"]) == 0
    assert "fuzzy k=2" in capsys.readouterr().out
    assert cli.main(["compare", *some, "--out", f"{folder}/c2", "--ns", "3", "--hashes", "32", "--bands", "5"]) == 2


def test_generated_rows(spark):
    docs = synthetic.background(spark, 30, 4).collect()
    assert docs == synthetic.background(spark, 50, 4).where("doc_key < 30").repartition(7).orderBy("doc_key").collect() and docs != synthetic.background(spark, 30, 5).collect()
    for d in docs:
        parts = [p.split(". ") for p in d["text"].split("\n\n")]
        assert 3 <= len(parts) <= 6 and all(3 <= len(p) <= 6 and all(8 <= len(s.split()) <= 18 and s[0].isupper() for s in p) for p in parts)
    rows = synthetic.items(spark, 400, 4).collect()
    assert len({r["question"] for r in rows}) == 400 and 150 < sum(bool(r["choices"]) for r in rows) < 250
    for r in rows:
        words = r["question"].rstrip("?").split()
        assert 16 <= len(words) <= 26 and sum(w[0].isdigit() for w in words) == 2 and len(r["choices"]) in (0, 4) and bool(r["answer"]) == bool(r["choices"])
    assert synthetic.items(spark, 50, 4, 1.0).where(F.size("choices") == 4).count() == 50

"""Readers, writers, reports, labels, duplicates, splits and the tree aggregation."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from braidsieve.functions.text import tokens_of
from braidsieve.operators import dupes, keystats, labels, numbering, report, split
from braidsieve.operators.treeagg import NODE, local_states, merged, tree_aggregate, tree_nodes
from braidsieve.sources import benchmarks, files
from braidsieve.sources.jsonl import read_jsonl, write_jsonl


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"id": "1", "t": "héllo"}\n\n  \n{"id": null, "x": 3}\n', encoding="utf-8")
    rows = read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, t string")
    assert sorted(map(tuple, rows.collect()), key=str) == [("1", "héllo"), (None, None)]
    for bad in ('{"id": ', "[1]", "3"):
        (tmp_path / "b.jsonl").write_text(f'{{"id": "1"}}\n{bad}\n')
        with pytest.raises(Exception, match="invalid JSON object"):
            read_jsonl(spark, str(tmp_path / "b.jsonl"), "id string").collect()
    assert write_jsonl(rows, str(tmp_path / "out")) == 2
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert "héllo" in text and text.count("\n") == 2


def test_benchmark_rows(spark, tmp_path):
    g = spark.createDataFrame([(0, "Q?", "A 4")], "index int, question string, answer string")
    assert tuple(benchmarks.gsm8k_items(g, "test").first()) == ("gsm8k:test:0", "gsm8k", "test", "Q?", [], "A 4")
    a = spark.createDataFrame([(0, "Mercury_1", "Q?", (["x", "y"], ["A", "B"]), "B"), (1, None, "R?", (["x"], ["A"]), "A")], "index int, id string, question string, choices struct<text:array<string>,label:array<string>>, answerKey string")
    assert [r["item_id"] for r in benchmarks.arc_items(a, "test").collect()] == ["arc_challenge:test:Mercury_1", "arc_challenge:test:1"]
    m = spark.createDataFrame([(0, "Q?", ["w", "x", "y", "z"], 2)], "index int, question string, choices array<string>, answer int")
    assert benchmarks.mmlu_items(m, "test").first()["answer"] == "C"
    with pytest.raises(Exception, match="outside the choices"):
        benchmarks.mmlu_items(m.withColumn("answer", F.lit(4)), "test").collect()
    g.drop("index").union(g.drop("index")).write.parquet(str(tmp_path / "g"))
    assert sorted(r["item_id"] for r in benchmarks.load_benchmark(spark, "gsm8k", str(tmp_path / "g")).collect()) == ["gsm8k:test:0", "gsm8k:test:1"]
    with pytest.raises(ValueError):
        benchmarks.load_benchmark(spark, "other", "x")
    (tmp_path / "mine.jsonl").write_text('{"item_id": "m:1", "question": "Q?"}\n')
    assert tuple(benchmarks.load_items_jsonl(spark, str(tmp_path / "mine.jsonl")).first()) == ("m:1", "mine", "test", "Q?", [], "")


def test_files(spark, tmp_path):
    hits = spark.createDataFrame([("b:1", "d", "EXACT", 1 / 32, 1, 2, 3, True, False, 0, "s")], files.HITS)
    assert files.write_hits(hits, str(tmp_path / "hits")) == 1
    assert files.read_hits(spark, str(tmp_path / "hits")).first()["containment"] == 0.0312
    files.write_csv(hits, str(tmp_path / "csv"))
    assert tuple(files.read_csv(spark, str(tmp_path / "csv"), files.HITS).first()) == tuple(hits.first())
    for content in ({"b": 1, "a": [2]}, {"b": "é"}):
        files.write_json(spark, str(tmp_path / "j/x.json"), content)
        assert files.read_json(spark, str(tmp_path / "j/x.json")) == content and files.names(spark, str(tmp_path / "j")) == ["x.json"]
    files.remove(spark, str(tmp_path / "j"))
    assert not files.exists(spark, str(tmp_path / "j")) and files.names(spark, str(tmp_path / "j")) == []
    with pytest.raises(FileNotFoundError):
        files.read_json(spark, str(tmp_path / "j/x.json"))
    git = tmp_path / "r" / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "packed-refs").write_text("# pack\nabc123 refs/heads/main\n")
    (tmp_path / "r" / "sub").mkdir()
    assert files.current_commit(tmp_path / "r" / "sub") == "abc123"
    (git / "refs/heads/main").write_text("def456\n")
    assert files.current_commit(tmp_path / "r") == "def456" and files.run_record({"n": 3})["config"] == {"n": 3}


def test_reports(spark):
    items = spark.createDataFrame([("a:1",), ("a:2",), ("b:1",), ("c:1",)], "item_id string")
    hits = spark.createDataFrame([("a:1", 1, 0.5, "x"), ("a:1", 3, 1.0, "y"), ("a:2", 2, 0.9, "x"), ("b:1", 1, 0.6, "x"), ("zz", 3, 1.0, "x")], "item_id string, rank int, containment double, doc_id string")
    rows = {r["benchmark"]: r for r in report.headline(items, items.where("item_id <> 'b:1'"), hits).collect()}
    assert (rows["a"]["partial_or_more"], rows["a"]["near_or_more"], rows["a"]["exact"]) == (2, 2, 1)
    assert (rows["b"]["indexed"], rows["b"]["partial_or_more"], rows["b"]["exact_high"]) == (0, 0, 1.0) and rows["c"]["partial_or_more"] == 0
    lengths = spark.createDataFrame([("a:1", 5), ("a:2", 20), ("b:1", 40), ("c:1", 9)], "item_id string, tokens int")
    flags = {r["min_tokens"]: r for r in report.flag_rates(lengths, items.where("item_id = 'c:1'"), hits, [3, 10, 100]).collect()}
    assert [flags[m]["eligible"] for m in (3, 10, 100)] == [3, 2, 0] and flags[10]["near_or_more"] == 1 and flags[100]["partial_or_more_high"] == 1.0
    assert report.filter_hits(hits, lengths, 10, 2).count() == 1
    assert {(r["bucket"], r["hits"], r["items"]) for r in report.hits_by_length(hits, lengths).collect()} == {("short", 2, 1), ("long", 2, 2)}
    other = hits.where("item_id <> 'a:2'").withColumn("rank", F.lit(1))
    level = {(r["benchmark"], r["level"]): r for r in report.compare_scans(items.where("item_id like 'a%'"), items.where("item_id <> 'c:1'"), hits, other).collect()}
    a = level["a", "PARTIAL"]
    assert (a["eligible_a"], a["in_both"], a["only_a"], level["a", "EXACT"]["in_b"]) == (2, 1, 1, 0) and a["difference_low"] < a["difference"] == 0.5 < a["difference_high"]
    assert (level["b", "PARTIAL"]["eligible_a"], level["b", "PARTIAL"]["in_b"], level["b", "PARTIAL"]["difference"]) == (0, 1, None)
    marked = hits.withColumn("label", F.expr("case when item_id = 'a:1' then 'true_contamination' when item_id = 'a:2' then 'benign_discussion' else 'coincidental' end"))
    shares = [tuple(r)[:5] for r in report.labelled_shares(items, marked, F.lit("web")).collect()]
    assert shares == [("web", "a", 2, 1, 2)]
    top = report.top_hits(hits.withColumns({"level": F.lit("EXACT"), "snippet": F.lit("a snippet " * 30)}), 2)
    text = report.show_report(report.headline(items, items, hits), top, {"documents": 9, "tokens": 90, "hits": 5, "finished": False}, 3)
    assert text.count("\n") == 9 and text.startswith("scan not finished: 9 documents, 90 tokens, 5 hits") and "items not searched: 3" in text and max(map(len, text.split("\n"))) <= 126


def test_labels(spark):
    rows = [(i, "﻿s" if i % 5 else "s", f" A:{i % 7}", f"d{i % 3}", "Near-Duplicate", float("nan") if i == 1 else i / 40, "t" if i % 2 else "True_Contamination ") for i in range(40)]
    hits = labels.clean_hits(spark.createDataFrame(rows, "hit_id long, stratum string, item_id string, doc_id string, level string, containment double, label string"))
    assert {r["label"] for r in hits.collect()} == {"true_contamination"} and hits.where("stratum <> 's' or item_id like ' %'").count() == 0
    assert hits.where("containment is null").count() == 1 and hits.first()["level"] == "NEAR_DUPLICATE"
    sample = labels.label_sample(hits, 5, 6).collect()
    assert Counter(r["part"] for r in sample) == {"top": 5, "random": 6} and min(r["containment"] for r in sample if r["part"] == "top") == 35 / 40
    picked = labels.annotation_pick(hits, {"true_contamination": 4}).collect()
    assert len(picked) == 4 and len({r["item_id"] for r in picked}) == 4
    # quotas of their own, filled from what earlier labels left; the first hit of a pair counts
    r = random.Random(5)
    many = [(i, f"i{r.randrange(12)}", f"d{r.randrange(3)}", r.choice(labels.LABELS[:3]), 0.5, "EXACT") for i in range(300)]
    quotas = {labels.LABELS[1]: 5, labels.LABELS[0]: 4, labels.LABELS[2]: 9, labels.LABELS[3]: 3}
    frame = spark.createDataFrame(many, "hit_id long, item_id string, doc_id string, label string, containment double, level string")
    got = labels.annotation_pick(frame, quotas)
    first = {}
    for h, i, d, label, *_ in many:
        first.setdefault((i, d), (h, label))
    rows = got.collect()
    assert len({x["item_id"] for x in rows}) == len(rows) and all(first[x["item_id"], x["doc_id"]] == (x["hit_id"], x["label"]) for x in rows)
    used: set = set()
    for label, quota in quotas.items():
        own = {x["item_id"] for x in rows if x["label"] == label}
        assert len(own) == min(quota, len({i for (i, _), (_, x) in first.items() if x == label} - used))
        used |= own
    pack = labels.annotation_pack(got).first()
    assert [x["hit_id"] for x in json.loads(pack["hits"])] != sorted(x["hit_id"] for x in rows) and len(json.loads(pack["answers"])) == len(rows) and "label" not in pack["hits"]
    with pytest.raises(ValueError):
        labels.annotation_pick(frame, {"no label": 1})
    pairs = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15 + [("a", None)], "first string, second string")
    assert labels.agreement(pairs).first()["kappa"] == pytest.approx(0.4) and labels.agreement(pairs.where("first = 'a' and second = 'a'")).first()["kappa"] == 1.0
    assert labels.label_summary(hits).first()["true_high"] == 1.0 and labels.first_of_pairs(hits).count() == 21


def test_similar_pairs_are_brute_force(spark):
    r = random.Random(3)
    texts = [(f"i{i:02}", " ".join(r.choice("abcd") for _ in range(r.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(texts, "id string, t string")
    sets = {}
    for i, t in texts:
        tok = tokens_of(t)
        if tok:
            sets[i] = {tuple(tok[p : p + 3]) for p in range(len(tok) - 2)} or {("whole", *tok)}
    for least in (0.34, 0.8):
        got = {(x["id_a"], x["id_b"]): x["jaccard"] for x in dupes.similar_pairs(dupes.shingle_sets(df, "id", F.col("t"), 3), least=least).collect()}
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
        assert got == pytest.approx({k: v for k, v in want.items() if v >= least - 1e-12})
    cross = dupes.similar_pairs(dupes.shingle_sets(df.limit(20), "id", F.col("t"), 3), dupes.shingle_sets(df, "id", F.col("t"), 3), least=1.0)
    assert cross.where("id_a = id_b").count() == 0
    with pytest.raises(ValueError):
        dupes.similar_pairs(df, least=0)


def test_signatures(spark):
    a, b = list(range(1000)), list(range(500, 1500))
    sets = spark.createDataFrame([("a", a), ("b", b), ("ab", sorted({*a, *b}))], "id string, shingles array<long>")
    signed = {r["id"]: r["signature"] for r in dupes.signatures(sets, 256).collect()}
    one = spark.createDataFrame([(signed["a"], signed["b"])], "x array<long>, y array<long>")
    assert one.select(dupes.merged_signature(F.col("x"), F.col("y"))).first()[0] == signed["ab"]
    assert one.select(dupes.estimated_jaccard(F.col("x"), F.col("y"))).first()[0] == pytest.approx(1 / 3, abs=0.12)
    with pytest.raises(Exception):
        one.select(dupes.estimated_jaccard(F.col("x"), F.slice("y", 1, 3))).collect()
    for block in (1, 4096):
        assert dupes.banded_candidates(dupes.signatures(sets, 256), 128, 2, block).count() == 3


def test_splits(spark):
    items = spark.createDataFrame([(f"i{i}", f"Question {i % 50}?" if i % 2 else f"question {i % 50}") for i in range(200)], "item_id string, question string")
    sides = split.split_items(items).groupBy(F.lower(F.regexp_replace("question", r"\W", ""))).agg(F.count_distinct("side").alias("n"))
    assert sides.where("n > 1").count() == 0
    docs = spark.range(4000).select(F.col("id").cast("string").alias("doc_id"))
    for out in (split.split_documents(docs, 0.3, 1), split.split_by_digest(docs, F.col("doc_id"), 0.3, 1)):
        assert out.where("side = 'dev'").count() == pytest.approx(1200, abs=120)
    with pytest.raises(ValueError):
        split.split_items(items, 1.0)


def test_tree_aggregation(spark):
    df = spark.range(20_000).repartition(37).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 101 != 0, (F.col("id") % 500).cast("string")).alias("k k"), "id")
    for fan_in, chunks in ((2, 37), (32, 100_000), (1000, 1)):
        out = tree_aggregate(df, ["k k"], {"n": (F.lit(1).cast("long"), "sum"), "most": (F.col("id"), "max"), "least": (F.col("id"), "min")}, fan_in, chunks)
        want = df.groupBy("k k").agg(F.count(F.lit(1)).alias("n"), F.max("id"), F.min("id"))
        assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert tree_aggregate(df.limit(0), ["k k"], {"n": (F.lit(1), "sum")}).count() == 0
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k k"], {}, 1)
    assert tree_nodes(800_000, 32) == [25_000, 782, 25, 1] and tree_nodes(1, 32) == [1]
    # with more chunks than the square of the fan-in, no reducer gets more than fan_in states of a key in any round
    states = {"n": (F.lit(1).cast("long"), "sum")}
    now = local_states(df, ["k k"], states).groupBy("k k", NODE).agg(F.sum("n").alias("n"))
    assert now.select(NODE).distinct().count() == 37
    for nodes in tree_nodes(37, 3):
        met = now.groupBy("k k", *([] if nodes == 1 else [F.floor(F.col(NODE) / 3).alias("up")])).count()
        assert met.agg(F.max("count")).first()[0] <= 3
        now = merged(now, ["k k"], states, 3, nodes == 1)
    assert now.agg(F.sum("n")).first()[0] == 20_000


def test_hits_per_key(spark):
    nan = float("nan")
    rows = [(" A ", "d", 0.5, "exact"), ("a", "d", nan, "?"), ("a", None, 1.5, None), (None, "d", 0.25, "near duplicate"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "item_id string, doc_id string, containment double, level string").withColumn("key_value", F.lit(0))
    got = {(r["field_name"], r["key_value"]): (r["hits"], r["mean_containment"], r["strongest"]) for r in keystats.hits_per_key(df).collect()}
    assert got == {("item_id", "a"): (3, 0.5, "EXACT"), ("item_id", None): (2, 0.25, "NEAR_DUPLICATE"), ("doc_id", "d"): (3, 0.375, "EXACT"), ("doc_id", None): (2, None, None)}
    assert {tuple(r) for r in keystats.hot_keys(df, 0.6).collect()} == {("item_id", "a"), ("doc_id", "d")}
    assert keystats.hits_per_key(df.limit(0)).count() == 0 and keystats.hot_keys(df.limit(0)).count() == 0


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(9)
    assert all(r["k"] == r["number"] for r in numbering.numbered(df, "k").collect())

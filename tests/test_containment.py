"""The overlap scan against brute force, and its edges."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidsieve.functions.text import tokens_of
from braidsieve.operators import containment as ct
from braidsieve.operators.items import QUESTION, QUESTION_CHOICES, corpus, within_budget

ITEM = "item_id string, benchmark string, split string, question string, choices array<string>, answer string"


def table(spark, rows):
    return spark.createDataFrame([(i, "b", "test", q, c, "") for i, q, c in rows], ITEM)


def documents(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_key long, text string").selectExpr("doc_key", "cast(doc_key as string) doc_id", "text")


def brute(items, docs, n, at, slack=None, stop_k=None, min_tokens=None):
    """{(item, doc): (level rank, matched, total, start)}"""
    least = min(4, n) if min_tokens is None else min_tokens
    texts = {i: tuple(tokens_of(q if not c else "\n".join([q, *c]))) for i, q, c in items}
    distinct = {t for t in texts.values() if len(t) >= least}
    grams = {t: {t[p : p + min(n, len(t))] for p in range(len(t) - min(n, len(t)) + 1)} for t in distinct}
    if stop_k:
        grams = {t: {g for g in gs if sum(g in o for o in grams.values()) < stop_k} for t, gs in grams.items()}
    out = {}
    for d, text in enumerate(docs):
        if text is None:
            continue
        tok = tuple(tokens_of(text))
        for i, t in texts.items():
            if not grams.get(t):
                continue
            size = min(n, len(t))
            found = [(p, tok[p : p + size]) for p in range(len(tok) - size + 1) if tok[p : p + size] in grams[t]]
            if not found:
                continue
            if slack is None:
                m, start = len({g for _, g in found}), found[0][0]
            else:
                span, m, start = max(1, math.ceil(slack * (len(t) - size + 1))), 0, -1
                for p, _ in found:
                    inside = [(q, g) for q, g in found if p - span < q <= p]
                    if len({g for _, g in inside}) > m:
                        m, start = len({g for _, g in inside}), inside[0][0]
            c = m / len(grams[t])
            exact = c >= at.near_duplicate and f" {' '.join(t)} " in f" {' '.join(tok)} "
            rank = 3 if exact else 2 if c >= at.near_duplicate else 1 if c >= at.partial else 0
            if rank:
                out[i, d] = (rank, m, len(grams[t]), start)
    return out


def got(hits):
    return {(h["item_id"], h["doc_key"]): (ct.LEVELS.index(h["level"]), h["matched_ngrams"], h["total_ngrams"], h["window_start"]) for h in hits.collect()}


@pytest.mark.parametrize("n, slack, stop_k, at", [(3, None, None, ct.Thresholds()), (2, 1.5, None, ct.Thresholds(0.3, 0.9)), (3, 1.0, 3, ct.Thresholds(0.2, 0.6)), (6, None, None, ct.ANY_OVERLAP)])
def test_scan_is_brute_force(spark, n, slack, stop_k, at):
    r = random.Random(n)
    items = [(f"b:{i}", " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12))), [r.choice("abc")] * r.choice([0, 0, 2])) for i in range(40)]
    items.append(("b:copy", items[0][1], items[0][2]))
    docs = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 60))) for _ in range(30)] + [None, "", items[3][1].upper()]
    index = ct.build_index(table(spark, items), n=n, stop_k=stop_k)
    hits = ct.scan(documents(spark, docs), index, at, window_slack=slack)
    assert got(hits) == brute(items, docs, n, at, slack, stop_k)


def test_roles(spark):
    question = "A farmer sells 12 crates of pears for $3 each, then buys 4 goats. How much money is left?"
    items = table(spark, [("b:math", question, []), ("b:short", "x = 7 y", []), ("b:tiny", "ok", []), ("b:never", "quartz sphinx judges my vow over and over", [])])
    docs = documents(spark, [f"Intro text.\n\n{question}\n\nMore.", question.upper().replace(" ", " "), question.replace("left", "gone"), "so x = 7, y holds", "nothing here", "", None])
    index = ct.build_index(items, view=QUESTION, n=6, min_tokens=4)
    hits = {(h["item_id"], h["doc_key"]): h for h in ct.scan(docs, index, snippet_chars=40).collect()}
    assert {k: h["level"] for k, h in hits.items()} == {("b:math", 0): "EXACT", ("b:math", 1): "EXACT", ("b:math", 2): "NEAR_DUPLICATE", ("b:short", 3): "EXACT"}
    assert hits["b:short", 3]["short"] and not hits["b:math", 2]["exact"] and hits["b:math", 0]["snippet"].startswith("a farmer sells 12")
    assert [(r["item_id"], r["reason"]) for r in index.skipped.collect()] == [("b:tiny", "too_short")]
    stats = ct.scan_stats(docs, ct.scan(docs, index)).first()
    assert (stats["documents"], stats["hits"], stats["malformed"]) == (6, 4, 1)
    assert index.summary().first()["indexed_items"] == 3


def test_settings(spark):
    for bad in ((0.0, 0.5), (0.6, 0.5), (0.5, 1.1)):
        with pytest.raises(ValueError):
            ct.Thresholds(*bad)
    items = table(spark, [("b:1", "a b c", [])])
    for how in ({"n": 0}, {"n": 3, "min_tokens": 4}, {"n": 3, "stop_k": 1}):
        with pytest.raises(ValueError):
            ct.build_index(items, **how)
    empty = ct.build_index(items.limit(0), n=3)
    assert ct.scan(documents(spark, ["a b c"]), empty).count() == 0
    choices = table(spark, [("b:1", "what", ["red fox", "blue hen"])])
    assert ct.build_index(choices, view=QUESTION, n=2).skipped.count() == 1
    assert ct.build_index(choices, view=QUESTION_CHOICES, n=2).skipped.count() == 0


def test_adaptive_size(spark):
    for lengths, want in (([20] * 40, 13), ([3, *[20] * 19], 3), ([3, *[20] * 30], 13), ([*range(1, 101)], 5), ([0], 1)):
        items = table(spark, [(f"b:{i}", " ".join(["w"] * k), []) for i, k in enumerate(lengths)])
        assert ct.adaptive_size(items).first()["n"] == want
    with pytest.raises(Exception):
        ct.adaptive_size(table(spark, [("x", "y", [])]).limit(0)).collect()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 4)), max_size=14), st.integers(1, 12))
def test_best_window(found, span):
    pairs = sorted(dict(found).items())
    m, start = ct.best_window(np.array([p for p, _ in pairs], np.int64), np.array([g for _, g in pairs], np.int64), span)
    best = (0, -1)
    for p, _ in pairs:
        inside = [(q, g) for q, g in pairs if p - span < q <= p]
        if len({g for _, g in inside}) > best[0]:
            best = (len({g for _, g in inside}), inside[0][0])
    assert (m, start) == best


def test_budget(spark):
    rows = [(i, None if i == 3 else f"d{i}", "t", t) for i, t in enumerate([5, None, 4, 3, 9, 1])]
    docs = corpus(spark.createDataFrame(rows, "k long, id string, text string, n long"), "k", "id", tokens="n")

    def ids(**how):
        return [r["doc_id"] for r in within_budget(docs, **how).orderBy("doc_key").collect()]

    assert ids() == ["d0", "d1", "d2", "row-3", "d4", "d5"]
    assert ids(max_tokens=9) == ["d0", "d1", "d2"] and ids(max_tokens=10) == ["d0", "d1", "d2", "row-3"]
    assert ids(max_tokens=100, max_docs=2) == ["d0", "d1"] and ids(max_tokens=0) == []


@pytest.mark.parametrize("slack", [None, 1.5])
def test_one_pass_and_joins_agree(spark, slack):
    """A small index, judged where the documents lie, gives the hits of the joins of a large one."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(50)]
    items = spark.createDataFrame([(f"b:{i}", " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 14))), []) for i in range(40)] + [("b:same", "w1 w2 w3 w4", []), ("b:again", "W1 w2, w3 w4!", [])], "item_id string, question string, choices array<string>")
    rows = [(i, f"d{i % 70}", " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 120)))) for i in range(80)] + [(100, "m", None), (101, "e", ""), (102, "x", "w1 w2 w3 w4 " * 3)]
    docs = spark.createDataFrame(rows, "doc_key long, doc_id string, text string")
    index = ct.build_index(items, n=3, min_tokens=1, stop_k=4)
    for at in (ct.Thresholds(0.3, 0.8), ct.ANY_OVERLAP):
        small, large = (ct.scan(docs, index, at, window_slack=slack, snippet_chars=30, block_grams=most) for most in (500_000, 0))
        assert small.dtypes == large.dtypes and sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) and small.count() > 20
    assert ct.scan(docs, ct.build_index(items.limit(0), n=3)).count() == 0


@pytest.mark.parametrize("slack", [None, 1.5])
def test_common_phrases_leave_no_table_of_candidates(spark, slack, monkeypatch):
    """Of texts made of the same phrases nearly all pairs are candidates; only hits are saved, whatever the rounds."""
    r = random.Random(5)
    phrases = [f"p{i} q{i} r{i}" for i in range(12)]
    words = [f"w{i}" for i in range(300)]
    mixed = lambda k: " ".join(r.choice(phrases) if r.random() < 0.3 else " ".join(r.choices(words, k=3)) for _ in range(k))
    items = [(f"b:{i}", mixed(6), []) for i in range(120)]
    docs = [mixed(r.randint(0, 20)) for _ in range(90)] + [items[7][1], "", None, "p1 q1"]
    rows, real = {}, ct.save

    def save(df, tag):
        made = real(df, tag)
        rows.setdefault(tag, []).append(made.rows)
        return made

    monkeypatch.setattr(ct, "save", save)
    monkeypatch.setattr(ct, "ROUND_GRAMS", 500, raising=False)
    at = ct.Thresholds(0.3, 0.9)
    hits = got(ct.scan(documents(spark, docs), ct.build_index(table(spark, items), n=2), at, window_slack=slack, block_grams=0))
    assert hits == brute(items, docs, 2, at, slack) and len(hits) > 20
    assert set(rows) == {"entries", "index", "hits"} and len(rows["hits"]) > 2 and sum(rows["hits"]) == len(hits)


def test_short_items_alone_are_searched(spark, tmp_path, monkeypatch):
    """The query of short items holds no longer ones, whose n-grams would fill the driver's memory."""
    from braidsieve.plans import overlap

    r = random.Random(4)
    asked = [" ".join(r.choices("abcdefgh", k=r.choice([1, 3, 5, 30, 60]))) for _ in range(60)] + ["A b, c!", "a b c"]
    items = [(f"b:{i}", q, r.sample(asked, 2) if i % 3 == 0 else []) for i, q in enumerate(asked)]
    rows = [(i, *row) for i, row in enumerate(items)]
    spark.createDataFrame(rows, "pos long, item_id string, question string, choices array<string>").write.parquet(f"{tmp_path}/mini_benchmark.parquet")
    short, real = [], ct.Block

    def block(*of):
        made = real(*of)
        short.extend(made.short)
        return made

    monkeypatch.setattr(ct, "Block", block)
    hits = got(overlap.short_item_hits(spark, str(tmp_path)))
    docs = ["\n".join([q, *c]) for _, q, c in items]
    want = brute([(i, q, []) for i, q, _ in items if len(tokens_of(q)) < 25], docs, 25, ct.Thresholds(), min_tokens=2)
    assert hits == want and len(hits) > 20
    assert short and all(short)


def test_hits_of_many_items_of_one_text_come_in_batches(spark):
    """Hits are kept once for each text and document and become rows of items batch by batch."""
    import pyarrow as pa

    same = table(spark, [(f"b:{i}", "one two three four", []) for i in range(3_000)] + [("b:other", "two three nine", [])])
    entries = ct.build_index(same, n=2, min_tokens=2).entries.toArrow()
    docs = pa.record_batch([pa.array(range(101)), pa.array([f"d{i}" for i in range(101)]), pa.array(["so one two three four"] * 100 + ["two three"])], ["doc_key", "doc_id", "text"])
    out = list(ct._scan_block(ct.Block(entries, 0.3), ct.Thresholds(0.3, 0.9), 1.5, 80)(iter([docs])))
    assert sum(b.num_rows for b in out) == 101 * 3_001 and max(b.num_rows for b in out) <= 60_000
    rows = [r for b in out for r in zip(*(b.column(c).to_pylist() for c in ("item_id", "doc_id", "level", "snippet")))]
    assert len(set(rows)) == len(rows) and {r[2:] for r in rows if r[0] != "b:other" and r[1] != "d100"} == {("EXACT", "one two three four")}

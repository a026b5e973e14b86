"""Normal forms, tokens, hashes and statistics."""

from __future__ import annotations

import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidsieve.functions import hashing, stats
from braidsieve.functions.text import gram_hashes, normal_form, normalize, token_count, token_line, tokenize, tokens_of, with_grams


@pytest.mark.parametrize(
    "text, want",
    [
        ("Well-known, (truly) FINE!", "well known truly fine"),
        ("a\t\n  b ", "a b"),
        ("zero​width­s", "zerowidths"),
        ("Ｆｕｌｌ ﬁne x²", "full fine x2"),
        ("Café", "café"),
        ("3+4=7 $5 _x_ 50%", "3+4=7 $5 x 50"),
        ("", ""),
        ("«¿?»", ""),
    ],
)
def test_normal_form(text, want):
    assert normalize(text) == want


def test_normalize_needs_a_text():
    with pytest.raises(TypeError):
        normalize(None)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_normal_form_is_stable(text):
    once = normalize(text)
    assert normalize(once) == once
    assert once == once.strip() and "  " not in once
    assert not any(unicodedata.category(c)[0] == "P" or unicodedata.category(c) == "Cf" for c in once)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aB_ .-\t\x1f\x7f+é​ﬁＦ²", max_size=20))
def test_tokens_in_one_pass(text):
    assert tokens_of(text) == tokenize(normalize(text))


def test_tokens():
    assert tokenize("12+30=42 <b>") == ["12", "+", "30", "=", "42", "<", "b", ">"]


def test_columns(spark):
    df = spark.createDataFrame([("A-b c", 0), (None, 1), ("", 2), ("x+y", 3)], "t string, i int").orderBy("i")
    rows = df.select(normal_form("t"), token_line("t").alias("l"), token_count(token_line("t"))).collect()
    assert [tuple(r) for r in rows] == [("a b c", "a b c", 3), (None, None, None), ("", "", 0), ("x+y", "x + y", 3)]
    grams = df.select(with_grams("t", [2, 5])["grams"].alias("g")).collect()
    assert [[] if g[0] is None else [p["pos"] for p in g[0]] for g in grams] == [[0, 1], [], [], [0, 1]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=8), max_size=4), st.integers(1, 4))
def test_gram_hashes_name_grams(texts, n):
    doc, pos, gram = gram_hashes(texts, [n])
    want = [(d, p, tuple(t[p : p + n])) for d, t in enumerate(texts) for p in range(len(t) - n + 1)]
    assert list(zip(doc.tolist(), pos.tolist())) == [(d, p) for d, p, _ in want]
    names: dict = {}
    for h, (_, _, g) in zip(gram.tolist(), want):
        assert names.setdefault(g, h) == h
    assert len(set(names.values())) == len(names)


def test_golden_hashes():
    assert hashing.token_hash("hello") == 555892909868921986
    assert hashing.token_hash("world") == 1743389483813212945
    one, two = hashing.token_hash("hello"), hashing.token_hash("world")
    assert hashing.gram_values(["hello", "world"], 2) == [(one * hashing.GRAM_BASE + two) % hashing.PRIME]
    assert hashing.gram_values(["hello"], 2) == []
    with pytest.raises(ValueError):
        hashing.gram_values(["a"], 0)
    assert 0 <= hashing.unit_interval(1, "x") < 1 and hashing.unit_interval(1, "x") != hashing.unit_interval(2, "x")
    assert hashing.stream(1, "a").random() == hashing.stream(1, "a").random() != hashing.stream(1, "b").random()


def test_wilson(spark):
    cases = [(0, 0), (0, 10), (10, 10), (5, 10), (1, 1000), (999, 1000)]
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame(cases, "k int, n int").select(low, high).collect()
    for (k, n), row in zip(cases, got):
        assert row[0] == pytest.approx(stats.wilson_interval(k, n)[0]) and row[1] == pytest.approx(stats.wilson_interval(k, n)[1])
    assert stats.wilson_interval(0, 0) == (0.0, 1.0)
    assert stats.wilson_interval(5, 10) == pytest.approx((0.2366, 0.7634), abs=1e-4)
    with pytest.raises(ValueError):
        stats.wilson_interval(3, 2)
    with pytest.raises(Exception):
        spark.createDataFrame([(3, 2)], "k int, n int").select(low).collect()


def test_banding_and_windows():
    assert stats.best_banding(0.5, 128) == (32, 4)
    assert stats.best_banding(0.001, 4) == (4, 1)
    assert stats.lsh_threshold(32, 4) == pytest.approx((1 / 32) ** 0.25)
    sizes = [stats.window_size(n) for n in (1, 8, 9, 12, 16)]
    assert sizes[:3] == [8, 8, 11] and all(s >= n for s, n in zip(sizes, (1, 8, 9, 12, 16)))
    assert math.isclose(1 - (1 - 0.5**4) ** 32, 0.873, abs_tol=1e-3)

"""Training-data operators against brute force, on small tables with every kind of dirt."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from braidsieve.llm import canonical, components, copies, leaks, neardup, packing, repetition, topn
from braidsieve.llm import text as tx
from braidsieve.llm.text import plain_form, record_fields, words_of

DIRTY = [None, "", " \n\t", "?!", "a", "x" * 200_000, "wörd " * 30_000, "​﻿", "ﬁnd ｆｕｌｌ 𝖺", "аpple", "é é"]


def runs(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


# ---------------------------------------------------------------- text


@pytest.mark.parametrize(
    "stored, plain",
    [
        ("ha­rb​or﻿", "harbor"),
        ("a b c　d\te\nf", "a b c d\te\nf"),
        ("ｆｕｌｌ 𝚝𝚑𝚎 ﬁsh", "full the fish"),
        ("café", "café"),
        ("Sheaѕheadek spοons", "Sheasheadek spoons"),
        ("spόons", "spóons"),
        ("дом и сад", "дом и сад"),
        ("νερό", "νερό"),
        ("e͏́a️", "éa"),
        ("Case, (marks)  stay!", "Case, (marks)  stay!"),
    ],
)
def test_plain_form(stored, plain):
    assert plain_form(stored) == plain
    assert plain_form(plain) == plain


def test_words():
    assert words_of("It's 50% a_b: 1+1=$2 <br>") == ["it", "s", "50", "a", "b", "1", "+", "1", "=", "$", "2", "<", "br", ">"]
    assert words_of(None) == words_of("") == words_of("?! --") == []
    assert [w for w in tx.pieces_of("One two. Three\nfour") if w not in "\n."] == words_of("One two. Three\nfour")


def test_fold_is_coarser_than_plain():
    for a, b in itertools.product([t for t in DIRTY if t], repeat=2):
        if plain_form(a) == plain_form(b):
            assert tx.fold(a) == tx.fold(b)
    assert tx.fold("STRASSE  x") == tx.fold("straße x")


def test_record_fields():
    assert record_fields("A: 1\n\nB: 2 | C: 3") == ["A: 1", "B: 2 ", " C: 3"]
    assert record_fields("A: 1\nB: 2") is None
    assert record_fields("A: 1\nB: 2\nC: 3\nplain line") is None
    assert record_fields(": 1\nB: 2\nC: 3") is None and record_fields("A:\nB: 2\nC: 3") is None and record_fields("--: 1\nB: 2\nC: 3") is None
    long = ["Date of first publication: 1999", f"{'x' * 300} {'y' * 300}: Rome: Italy", "one two three four five six seven: Ann"]
    for order in itertools.permutations(long):
        assert record_fields("\n".join(order)) == list(order)
        assert copies.written_keys(" | ".join(order))["rec"] == copies.written_keys("\n\n".join(long).upper())["rec"]


# ---------------------------------------------------------------- top n


def test_top_in_groups_over_many_partitions(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", None, "b", "c"]), r.choice([0.5, 1.0, None]), i, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, score double, id long, position string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = topn.top_in_groups(df, ["g"], [F.col("score").desc_nulls_last(), F.col("id")], 5).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = set()
    for g in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-(x[1] if x[1] is not None else -1), x[2]))[:5]
        want |= {(g, x[2], i + 1) for i, x in enumerate(own)}
    assert {(x["g"], x["id"], x["position_"]) for x in out} == want
    assert topn.top_in_groups(df.limit(0), ["g"], [F.col("id")], 2).count() == 0


def test_strongest_hits(spark):
    nan = float("nan")
    rows = [
        (1, " A:1", "d1", "partial", 0.6), (2, "a:1", "d1", "EXACT", 0.1), (3, "a:1 ", "d2", "near duplicate", 0.9), (4, "a:1", "d3", "Near-Duplicate", 0.9), (5, "a:1", "d4", "none", 0.9),
        (6, None, "d", "EXACT", 1.0), (7, "a:1", None, "EXACT", 1.0), (8, "b", "d", "?", 1.0), (9, "b", "d", "EXACT", nan), (10, "b", "d", "EXACT", 1.5), (11, "b", "d", None, 1.0), (12, "b", "d", "EXACT", None), (2, "a:1", "d1", "EXACT", 0.1),
    ]
    df = spark.createDataFrame(rows, "hit_id long, item_id string, doc_id string, level string, containment double").withColumn("rank", F.lit("clash"))
    got = [(r["item_id"], r["hit_id"]) for r in topn.strongest_hits(df).orderBy("item_id", "position").collect()]
    assert got == [("a:1", 2), ("a:1", 3), ("a:1", 4)]


# ---------------------------------------------------------------- components


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(500, 500), (7, None)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    out, saved = components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b")
    assert {(x[0], x[1]) for x in out.collect()} == {(n, find(n)) for n in parent}
    saved.drop()
    empty, saved = components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b")
    assert empty.count() == 0


# ---------------------------------------------------------------- near-duplicates


def _texts(r, n=60):
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(3, 40))] for _ in range(n // 3)]
    out = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append((f"i{i:03}", (" ".join(words)).title() + "!"))
    return out


def test_near_duplicates(spark):
    rows = _texts(random.Random(2)) + [(f"d{i}", t) for i, t in enumerate(DIRTY)] + [(None, "a b c d")] + [(f"copy{i}", "same words here again") for i in range(25)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("n", F.lit(1)).withColumn("words", F.lit("clash"))
    sets = {i: runs(words_of(t), 3) for i, t in rows if i is not None}
    sets = {i: s for i, s in sets.items() if s}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    found = neardup.near_duplicates(df, "id", "t", k=3, least=0.5)
    got = [(r["id_a"], r["id_b"]) for r in neardup.id_pairs(found).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    laid_out = neardup.near_duplicates(df, "id", "t", k=3, least=0.5, cell=2, part_keys=500)
    again = [(r["id_a"], r["id_b"]) for r in neardup.id_pairs(laid_out, block=4).collect()]
    assert len(again) == len(set(again)) and set(again) == want
    group = {r["id"]: r["group_id"] for r in neardup.groups(found).collect()}
    assert set(group) == set(sets) and all(group[a] == group[b] for a, b in want)
    assert all(g <= i for i, g in group.items())
    listed = [(" " + a.upper(), b, 1.0) for a, b in sorted(want)[:5]] + [("x", "y", 0.9), ("x", "x", 1.0), (None, "y", 0.2)] + [(b, a, float("nan")) for a, b in sorted(want)[5:7]]
    status = Counter(r["status"] for r in neardup.reconcile(spark.createDataFrame(listed, "id_a string, id_b string, jaccard double"), found).collect())
    assert status["removed"] == 1 and status["kept"] + status["rescored"] == 7
    # what is listed, kept or added, leads from every id to all that are linked with it
    rows_ = [r for r in neardup.reconcile(spark.createDataFrame(listed, "id_a string, id_b string, jaccard double"), found).collect() if r["status"] != "removed"]
    assert len({(r["id_a"], r["id_b"]) for r in rows_}) == len(rows_) and {(r["id_a"], r["id_b"]) for r in rows_} <= want
    near: dict = {}
    for r in rows_:
        near.setdefault(r["id_a"], set()).add(r["id_b"]), near.setdefault(r["id_b"], set()).add(r["id_a"])
    for a, b in want:
        seen, todo = {a}, [a]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        assert b in seen
    assert neardup.id_pairs(neardup.near_duplicates(df.limit(0), "id", "t", k=3, least=0.5)).count() == 0


def test_no_cell_is_large(spark):
    """A bucket that holds a third of all rows is parted into cells of bounded size, which compare each pair once."""
    rows = [(1, i) for i in range(3000)] + [(2 + i % 3000, 5000 + i) for i in range(6000)]
    out = neardup.cells(spark.createDataFrame(rows, "band long, n long"), 64).toPandas()
    assert out.groupby(["band", "x", "y"]).size().max() <= 128
    met = Counter()
    for _, own in out[out["band"] == 1].groupby(["x", "y"]):
        at = list(zip(own["n"], own["block"]))
        one = own["x"].iloc[0] == own["y"].iloc[0]
        met.update((min(a, b), max(a, b)) for (a, p), (b, q) in itertools.combinations(at, 2) if one or p != q)
    assert len(met) == 3000 * 2999 // 2 and set(met.values()) == {1}


def test_band_blocks_keep_every_shared_key():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    lists = [sorted(set(rng.integers(0, 40, rng.integers(1, 4)).tolist())) for _ in range(400)] + [[7, 8]] * 200
    n = np.cumsum(rng.integers(1, 1 << 20, len(lists)))
    batch = pa.record_batch([pa.array(n), pa.array(lists, pa.list_(pa.int32()))], ["n", "runs"])
    want = Counter()
    own: dict = {}
    runs_ = np.concatenate([np.array(x, np.uint32) for x in lists])
    ends = np.cumsum([len(x) for x in lists])
    keys = neardup.band_keys(neardup.minima(runs_, np.append(0, ends[:-1]), 12), 6, 2) >> np.uint64(16)
    for row in keys:
        for k, x in zip(row.tolist(), n.tolist()):
            own.setdefault(k, []).append(x)
    want = {(k, x) for k, v in own.items() if len(v) > 1 for x in v}
    for size in (1 << 21, 6000, 600):
        blocks = [b for i in range(0, 600, 150) for b in neardup._band_blocks(6, 2, 5, size)(iter([batch.slice(i, 150)]))]
        table = pa.Table.from_batches(blocks).sort_by("part")
        got = [(a, b) for o in neardup._shared(iter(table.to_batches(max_chunksize=3))) for a, b in zip(o.column(0).to_pylist(), o.column(1).to_pylist())]
        assert len(got) == len(set(got)) and set(got) == want


# ---------------------------------------------------------------- canonical texts, copies


def test_look_alike_pairs(spark):
    texts = ["full text", "ｆｕｌｌ text", "full text", "Full text", "full text", *DIRTY, "appl​e", "apple", "аpple"]
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)] + [("u", 1, "ｆull text")], "table_name string, pos long, text string").withColumn("plain", F.lit(0))
    want = {
        (a, b) for (a, x), (b, y) in itertools.combinations([(i, t) for i, t in enumerate(texts) if words_of(t)], 2) if x != y and plain_form(x) == plain_form(y)
    }
    out, _ = canonical.look_alike_pairs(df)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == {("t", a, b) for a, b in want}
    named = canonical.canonical_texts(df.withColumn("plain_text", F.lit(1)), "text")
    assert {"plain_text", "plain_text_", "text_key"} <= set(named.columns)


def test_copies(spark):
    card = ["Name: Ann Bo", "Place: Rome", "Age: 7"]
    texts = ["A b, c!", "a  B c", "a c b", *DIRTY, "\n".join(card), " | ".join(card[::-1]), "name: ann bo place: rome age: 7", "NAME : Ann Bo\n\nAGE: 7\nPlace: Rome", "place: rome name: ann bo age: 7"]
    texts += ["hot copy of a text"] * 50
    # one run of words that parts into two unlike cards
    texts += ["a: b\nc: d\ne: f", "a: b c\n: d e: f", "a: b c: d\nx: y\ne: f", "x: y\ne: f\na: b c: d"]
    rows = [("t", i, t) for i, t in enumerate(texts)] + [("u", i, t) for i, t in enumerate(texts[:3])]
    df = spark.createDataFrame(rows, "table_name string, pos long, text string").withColumn("key", F.lit("clash"))
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for table, i, t in rows:
        if not words_of(t):
            continue
        fields = record_fields(plain_form(t))
        parts = [tuple(words_of(f)) for f in fields] if fields else [tuple(words_of(t))]
        parent[find((table, i))] = find((table, "seq", sum(parts, ())))
        if fields:
            parent[find((table, i))] = find((table, "rec", tuple(sorted(parts))))
    classes = defaultdict(list)
    for table, i, t in rows:
        if words_of(t):
            classes[find((table, i))].append((table, i))
    want = {(m[0][0], min(m)[1], i) for m in classes.values() for _, i in m if i != min(m)[1]}
    out, _ = copies.copy_rows(df)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    whole, _ = copies.records(df)
    assert {(r["table_name"], r["first_pos"], r["copies"]) for r in whole.collect()} == {(m[0][0], min(m)[1], len(m)) for m in classes.values()}
    assert copies.copy_rows(df.limit(0))[0].count() == 0


def test_cards_joined_by_one_run_of_words(spark):
    texts = ["a: b\nc: d\ne: f", "a: b | c: d e: f | g: h", "a: b c: d\ne: f\ng: h", "e: f\ng: h\na: b c: d", "g: h | c: d e: f | a: b"]
    out, _ = copies.records(spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "table_name string, pos long, text string"))
    assert sorted(r["copies"] for r in out.collect()) == [1, 4]


# ---------------------------------------------------------------- packing


def test_packing(spark):
    texts = DIRTY + ["word " * n for n in (1, 10, 100, 700, 1500, 2048, 2049, 9000)] + ["some words here " * 40] * 40
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("start", F.lit("clash"))
    out = packing.pack(df, capacity=2048, shard_docs=30).collect()
    sizes = defaultdict(list)
    for r in out:
        if r["sequence"] is None:
            assert r["n_tokens"] == 0
        else:
            sizes[r["sequence"]].append((r["start"], r["n_tokens"]))
    for own in sizes.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at <= 2048
    enc = packing.encoding(packing.TOKENIZER, packing.PATTERN)
    assert sum(r["n_tokens"] for r in out) == sum(len(enc.encode_ordinary(t)) for t in texts if t)
    assert all(r["n_tokens"] == 2048 for r in out for s in out if r["doc_id"] == s["doc_id"] and r["piece"] < s["piece"] and s["n_tokens"] and r["n_tokens"] > 1500)
    assert packing.pack(df.limit(0)).count() == 0
    # ids beyond 2^53 stay as they are beside a null, and every shard has a partition of its own
    far = spark.createDataFrame([((1 << 60) + 1, "a b"), ((1 << 60) + 2, "c"), (None, "d e f")], "doc_id long, text string")
    assert {r["doc_id"] for r in packing.pack(far, shard_docs=10).collect()} == {(1 << 60) + 1, (1 << 60) + 2, None}
    own = packing.pack(df, shard_docs=7).where("sequence is not null").withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count_distinct(F.shiftright("sequence", 32)).alias("shards")).collect()
    assert len(own) > 1 and all(r["shards"] == 1 for r in own)


def test_sum_of_squares_is_close_to_full():
    r = random.Random(5)
    sizes = [r.randint(1, 700) for _ in range(3000)]
    bins, made = packing.sum_of_squares(sizes, 2048)
    fill = Counter()
    for s, b in zip(sizes, bins.tolist()):
        fill[b] += s
    assert max(fill.values()) <= 2048 and made == len(fill)
    assert len(set(packing.pack_shard(sizes, 2048)["bin"].tolist())) <= -(-sum(sizes) // 2048) + 2


# ---------------------------------------------------------------- leaks


def test_fm_index_against_brute_force():
    import numpy as np

    from braidsieve.llm.fmindex import FMIndex

    rng = np.random.default_rng(1)
    for trial in range(150):
        n, top = int(rng.integers(0, 60)), int(rng.integers(1, 6))
        c = rng.integers(0, top + 1, n)
        if trial % 3 == 0 and n > 20:
            c[10:20] = c[:10]
        index, k = FMIndex(c, top, every=int(rng.integers(1, 5))), int(rng.integers(1, 4))
        patterns = rng.integers(0, top + 2, (20, k))
        for p, lo, hi in zip(patterns, *index.search(patterns)):
            want = [i for i in range(n - k + 1) if (p > 0).all() and (c[i : i + k] == p).all()]
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def test_leaks(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    questions = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 14))) for _ in range(30)]
    items = [(f"q{i}", q) for i, q in enumerate(questions)] + [("same", questions[0]), ("none", None), ("empty", "")]
    docs = []
    for i in range(80):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        if i % 2:
            q = r.choice(questions).split()
            at = r.randrange(len(words) + 1)
            words[at:at] = q[: r.randint(1, len(q))]
        docs.append((i, " ".join(words).upper() if i % 3 else " ".join(words)))
    docs += [(100 + i, t) for i, t in enumerate(DIRTY)] + [(200, " ".join(questions[:10]) + " " + "zz " * 5000 + questions[11]), (3, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    q = spark.createDataFrame(items, "item_id string, question string").withColumn("text", F.lit("clash"))
    want = []
    for doc, t in docs:
        have = runs(words_of(t), 3)
        for item, text in items:
            own = runs(words_of(text), 3)
            if own and 2 * len(own & have) >= len(own):
                want.append((doc, item, len(own & have), len(own)))
    for block, words in ((1_000_000, 2_000_000), (17, 60)):
        out = leaks.find_leaks(d, q, block_words=block, words_a_block=words).collect()
        assert sorted((x["doc_id"], x["item_id"], x["found_runs"], x["all_runs"]) for x in out) == sorted(want)
        words_in = {doc: words_of(t) for doc, t in docs}
        for x in out:
            own = runs(words_of(dict(items)[x["item_id"]]), 3)
            spans = [(s["start_word"], s["end_word"]) for s in x["spans"]]
            assert all(a[1] < b[0] for a, b in itertools.pairwise(spans))
            inside = set().union(*(runs(words_in[x["doc_id"]][a:b], 3) for a, b in spans))
            assert own & inside == own & runs(words_in[x["doc_id"]], 3)
    assert leaks.find_leaks(d.limit(0), q).count() == 0 and leaks.find_leaks(d, q.limit(0)).count() == 0


# ---------------------------------------------------------------- repetition


def test_the_field_marks_what_repeats():
    model = repetition.line_model()
    texts = ["fresh words stand on this line only\n" * 1 + "Another line that says something else\n" * 6 + "and one more thing to close it all"]
    m = repetition.measure(texts, 5, model)
    assert m["content"][0] < m["words"][0] * 0.6 <= m["words"][0] * repetition.retention_cut()


def test_the_field_on_held_out_pages():
    """Generated pages on which it was neither fitted nor cut: nine of ten lines are labelled as they were made, and the
    field alone finds nearly all pages that repeat."""
    import numpy as np

    rng, model, cut = np.random.default_rng(99), repetition.line_model(), repetition.retention_cut()
    true = both = right = lines = 0
    for _ in range(600):
        codes, start, label = repetition._page(rng)
        zero = np.zeros(len(codes), np.int64)
        m = repetition.judge(codes, zero, start, 1, 5, model)
        lengths = np.diff(np.append(start, len(codes)))
        marked = repetition.viterbi(repetition.line_features(codes, zero, start) @ model[0], model[1], np.array([len(start)]))
        right, lines = right + int((marked == label).sum()), lines + len(lengths)
        t, f = m["words"][0] >= 20 and m["repeated"][0] >= 0.3 * m["runs"][0], m["words"][0] >= 20 and m["content"][0] <= cut * m["words"][0]
        true, both = true + t, both + (t and f)
    assert both >= 0.99 * true and true > 50 and right >= 0.9 * lines


def test_viterbi_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = rng.integers(0, 6, 5)
        emit, move = rng.normal(size=(int(lengths.sum()), 2)), rng.normal(size=(2, 2))
        got, at = repetition.viterbi(emit, move, lengths), 0
        for n in lengths.tolist():
            def value(y, at=at, n=n):
                return sum(emit[at + i, y[i]] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1))

            if n:
                best = max(itertools.product((0, 1), repeat=n), key=value)
                assert tuple(got[at : at + n].tolist()) == best
            at += n


def test_repetition(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = list(DIRTY)
    for i in range(150):
        line = " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 12)))
        own = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 12))]
        for _ in range(r.randint(0, 8)):
            own.insert(r.randrange(len(own) + 1), line)
        texts.append(r.choice([". ", "\n", " "]).join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("words", F.lit("clash"))
    want = set()
    for i, t in enumerate(texts):
        w = words_of(t)
        if len(w) >= 20 and 1 - len(runs(w, 5)) / (len(w) - 4) >= 0.3:
            want.add(i)
    assert {x["doc_id"] for x in repetition.repetitive(df).collect()} == want
    shares = {x["doc_id"]: x for x in repetition.repetition(df, batch_docs=7).collect()}
    assert len(shares) == len(texts) and shares[0]["content_share"] == 1.0 and shares[0]["words"] == 0
    assert repetition.repetition(df.limit(0)).count() == 0

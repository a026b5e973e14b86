"""Evaluation texts that stand in training texts (problem 7).

Every task indexes its own shard of documents, block by block, with an FM-index over words (``fmindex``): the distinct
k-runs of the test items are searched backward through the wavelet ranks, their occurrences are located by sampled
suffix positions, and the found runs are counted for each (document, item).  A document lies in one task as a whole,
so nothing is shuffled.

The test items reach the tasks in blocks of at most ``words_a_block`` words, so what is broadcast has a fixed bound;
beyond one block the documents are read once for each block.  A document longer than a shard block is indexed in pieces
that overlap by k-1 words, with one set of found runs.

Defined results: null or empty texts and items of fewer than k words give no row; each row of the documents is judged on
its own, also where its id is repeated; items with equal questions are each reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidsieve.llm import text as tx
from braidsieve.llm.fmindex import FMIndex
from braidsieve.session import spread


class Patterns:
    """The distinct k-runs of a block of items, and which items hold each."""

    def __init__(self, items: list[tuple[str, list[str]]], k: int) -> None:
        self.k, self.code, runs = k, {}, {}
        self.items, owner, run_of = [], [], []
        total = []
        for name, words in items:
            coded = [self.code.setdefault(w, len(self.code) + 1) for w in words]
            own = {tuple(coded[i : i + k]) for i in range(len(coded) - k + 1)}
            if not own:
                continue
            for r in sorted(own):
                run_of.append(runs.setdefault(r, len(runs)))
                owner.append(len(self.items))
            self.items.append(name)
            total.append(len(own))
        self.runs = np.array(list(runs), np.int64).reshape(-1, k)
        self.total = np.array(total, np.int64)
        by = np.argsort(np.array(run_of, np.int64), kind="stable")
        self.owner = np.array(owner, np.int64)[by]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(np.array(run_of, np.int64), minlength=len(runs)))]).astype(np.int64)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of starts[i] .. starts[i] + counts[i] - 1, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def find_in_block(pieces: list[tuple[int, int, np.ndarray]], p: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, run, word position) of every occurrence in a block of pieces (document, offset, codes)."""
    lengths = np.array([len(c) + 1 for _, _, c in pieces], np.int64)
    starts = np.cumsum(lengths) - lengths
    codes = np.zeros(int(lengths.sum()), np.int32)
    for s, (_, _, c) in zip(starts, pieces):
        codes[s : s + len(c)] = c
    index = FMIndex(codes, len(p.code))
    lo, hi = index.search(p.runs)
    run = np.repeat(np.arange(len(lo)), hi - lo)
    at = index.locate(_spread(lo, hi - lo))
    piece = np.searchsorted(starts, at, side="right") - 1
    doc = np.array([d for d, _, _ in pieces], np.int64)[piece]
    return doc, run, at - starts[piece] + np.array([o for _, o, _ in pieces], np.int64)[piece]


def _judge(doc: np.ndarray, run: np.ndarray, at: np.ndarray, p: Patterns, least: float) -> Iterator[tuple[int, int, int, list]]:
    """(document, item, found distinct runs, merged word spans) where the share of found runs is at least ``least``."""
    if not len(doc):
        return
    pairs = np.unique(doc * len(p.runs) + run)
    d, r = pairs // len(p.runs), pairs % len(p.runs)
    counts = p.first[r + 1] - p.first[r]
    item = p.owner[_spread(p.first[r], counts)]
    key, found = np.unique(np.repeat(d, counts) * len(p.items) + item, return_counts=True)
    held = found >= np.ceil(least * p.total[key % len(p.items)] - 1e-9)
    if not held.any():
        return
    by = np.argsort(doc, kind="stable")
    doc, run, at = doc[by], run[by], at[by]
    own: dict[int, set[int]] = {}
    for i in np.unique(key[held] % len(p.items)).tolist():
        own[i] = set()
    counts = np.diff(p.first)
    for i, x in zip(p.owner.tolist(), np.repeat(np.arange(len(p.runs)), counts).tolist()):
        if i in own:
            own[i].add(x)
    for k, n in zip(key[held].tolist(), found[held].tolist()):
        dd, i = divmod(k, len(p.items))
        a, b = np.searchsorted(doc, [dd, dd + 1])
        here = sorted(x for x, y in zip(at[a:b].tolist(), run[a:b].tolist()) if y in own[i])
        spans: list[list[int]] = []
        for x in here:
            if spans and x <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], x + p.k)
            else:
                spans.append([x, x + p.k])
        yield dd, i, n, spans


_SPANS = T.ArrayType(T.StructType([T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())]))
_SPANS_PA = pa.list_(pa.struct([("start_word", pa.int32()), ("end_word", pa.int32())]))


def _scan(p: Patterns, least: float, block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        id_type = pa.null()
        pieces: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            docs, runs, ats, block, n = [], [], [], [], 0
            for x in [*pieces, None]:
                if x is None or (block and n + len(x[2]) > block_words):
                    a, b, c = find_in_block(block, p)
                    docs.append(a), runs.append(b), ats.append(c)
                    block, n = [], 0
                if x is not None:
                    block.append(x)
                    n += len(x[2]) + 1
            rows = list(_judge(np.concatenate(docs), np.concatenate(runs), np.concatenate(ats), p, least))
            return pa.record_batch(
                [
                    pa.array([ids[d] for d, *_ in rows], id_type),
                    pa.array([p.items[i] for _, i, *_ in rows], pa.string()),
                    pa.array([n for _, _, n, _ in rows], pa.int32()),
                    pa.array([int(p.total[i]) for _, i, *_ in rows], pa.int32()),
                    pa.array([[{"start_word": a, "end_word": b} for a, b in s] for *_, s in rows], _SPANS_PA),
                ],
                ["doc_id", "item_id", "found_runs", "all_runs", "spans"],
            )

        code = p.code.get
        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = tx.words_of(text.as_py())
                if len(words) < p.k:
                    continue
                codes = np.fromiter((code(w, 0) for w in words), np.int32, len(words))
                for o in range(0, max(1, len(codes) - p.k + 1), block_words):
                    pieces.append((len(ids), o, codes[o : o + block_words + p.k - 1]))
                ids.append(name)
                size += len(codes)
                if size >= block_words:
                    yield flush()
                    ids, pieces, size = [], [], 0
        if pieces:
            yield flush()

    return run


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    question: str = "question",
    k: int = 3,
    least: float = 0.5,
    block_words: int = 1_000_000,
    words_a_block: int = 2_000_000,
) -> DataFrame:
    """Rows (doc_id, item_id, found_runs, all_runs, spans) where at least ``least`` of the item's distinct k-runs stand in
    the document; spans are merged ranges of the document's words, the end not included."""
    if k < 1 or not 0 < least <= 1:
        raise ValueError("k must be at least 1 and least within (0, 1]")
    coded = items.select(F.col(item_id).cast("string").alias("item"), tx.words(question).alias("words")).where(F.size("words") >= k)
    total = coded.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / words_a_block))
    docs = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("item_id", T.StringType()), T.StructField("found_runs", T.IntegerType()), T.StructField("all_runs", T.IntegerType()), T.StructField("spans", _SPANS)]
    )
    out = None
    for b in range(blocks):
        mine = coded if blocks == 1 else coded.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        held = [(r["item"], list(r["words"])) for r in mine.orderBy("item").toLocalIterator()]
        found = docs.where(F.length("text") > 0).mapInArrow(_scan(Patterns(held, k), least, block_words), schema)
        out = found if out is None else out.unionByName(found)
    return out

"""Heavily edited copies: windows of about an item's length over each document, MinHash banding, exact verification.

The index is sent to the tasks in blocks of at most ``block_shingles`` shingles, so what is broadcast is bounded; beyond one
block the documents are read once for each.  A document is judged within one task, by arrays: hashes of its shingles,
minima over sliding windows, band keys looked up among the entries' keys.  Reported containments are exact.

Which windows become candidates depends on the hash family.  Windows start at every eighth of their length, so of a
verbatim copy at least seven eighths lie within one of them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidsieve.functions.stats import window_size
from braidsieve.functions.text import gram_hashes, token_count, tokens_of
from braidsieve.operators.containment import entry_lines
from braidsieve.operators.items import QUESTION
from braidsieve.session import spread


class FuzzyIndex:
    """Entries of one block: item ids, shingle sets, windows and band keys."""

    def __init__(self, entries: list[tuple[list[str], str]], k: int, hashes: int, bands: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.k, self.bands, self.rows = k, bands, hashes // bands
        self.a = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)
        self.ids = [ids for ids, _ in entries]
        doc, _, gram = gram_hashes([line.split(" ") for _, line in entries], [k])
        cut = np.searchsorted(doc, np.arange(len(entries) + 1))
        self.sets = [np.unique(gram[cut[i] : cut[i + 1]]) for i in range(len(entries))]
        self.windows = [window_size(len(s)) for s in self.sets]
        self.every = np.unique(gram)
        self.fewest = {w: min(len(s) for s, v in zip(self.sets, self.windows) if v == w) for w in set(self.windows)}
        self.by_window: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        keyed: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, s in enumerate(self.sets):
            for key in self.keys(self.values(s).min(axis=1, keepdims=True).T)[0].tolist():
                keyed[self.windows[i]][key].append(i)
        for w, table in keyed.items():
            self.by_window[w] = (np.array(sorted(table), np.uint64), dict(table))

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """hashes x shingles."""
        return ((shingles.view(np.uint64)[None, :] * self.a[:, None] + self.b[:, None]) >> np.uint64(32)).astype(np.uint32)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """texts x bands, from texts x hashes."""
        out = np.zeros((len(signatures), self.bands), np.uint64)
        for j in range(self.rows):
            part = signatures[:, j :: self.rows][:, : self.bands].astype(np.uint64)
            out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out ^ (np.arange(self.bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def scan(self, tokens: list[str], least: float, min_shared: int, piece: int = 1 << 16) -> list[tuple[int, int, int]]:
        """(entry, matched shingles, window start) of entries contained well enough.

        A document is gone through in pieces of ``piece`` window starts, so what is held at once does not grow with it."""
        _, _, gram = gram_hashes([tokens], [self.k])
        known = np.isin(gram, self.every)
        if len(np.unique(gram[known])) < max(1, min_shared):
            return []
        seen = np.append(0, np.cumsum(known))
        found: dict[int, tuple[int, int]] = {}  # entry: matched, -start, so that the first of the best stays
        longest = max(self.by_window)
        for p in range(0, len(gram), piece):
            part = gram[p : p + piece + longest - 1]
            hashed = None
            for w, (keys, table) in self.by_window.items():
                starts = self._starts(seen, w, p, piece, least)
                if not len(starts):
                    continue
                hashed = self.values(part) if hashed is None else hashed
                views = np.lib.stride_tricks.sliding_window_view(hashed, min(w, len(part)), axis=1)[:, starts - p]
                own = self.keys(views.min(axis=2).T)
                met = np.isin(own, keys)
                for j in np.flatnonzero(met.any(axis=1)).tolist():
                    window = part[starts[j] - p : starts[j] - p + w]
                    for e in set(chain.from_iterable(table[key] for key in own[j][met[j]].tolist())):
                        found[e] = max(found.get(e, (0, 0)), (int(np.isin(self.sets[e], window).sum()), -int(starts[j])))
        return [(e, m, -s) for e, (m, s) in sorted(found.items()) if m and m >= least * len(self.sets[e]) - 1e-12]

    def _starts(self, seen: np.ndarray, w: int, p: int, piece: int, least: float) -> np.ndarray:
        """The windows of width w that begin within the piece and hold enough known shingles for the smallest entry of that
        width; seen: known shingles before each place."""
        whole = len(seen) - 1
        last, step = max(0, whole - w), max(1, w // 8)
        starts = np.arange(-(-p // step) * step, min(p + piece, last + 1), step)
        if p <= last < p + piece:
            starts = np.union1d(starts, [last])
        return starts[seen[np.minimum(starts + w, whole)] - seen[starts] >= max(1, math.ceil(least * self.fewest[w] - 1e-9))]


HITS = T.StructType(
    [T.StructField("item_id", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("matched_shingles", T.IntegerType()), T.StructField("total_shingles", T.IntegerType()), T.StructField("window_start", T.IntegerType())]
)


def fuzzy_entries(items: DataFrame, *, view: str = QUESTION, k: int = 3, min_tokens: int = 8) -> tuple[DataFrame, DataFrame]:
    """(line, tokens, item_ids) of the items long enough, and (item_id, reason) of the others."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return entry_lines(items, view, max(min_tokens, k + 1))


def fuzzy_scan(
    docs: DataFrame, items: DataFrame, *, view: str = QUESTION, k: int = 3, hashes: int = 64, bands: int = 32, min_tokens: int = 8, least: float = 0.3, min_shared: int = 3, seed: int = 0, block_shingles: int = 2_000_000
) -> DataFrame:
    """Items whose shingles are at least ``least`` contained in some window of a document (``HITS``)."""
    if bands < 1 or hashes % bands:
        raise ValueError("bands must divide the number of hashes")
    entries, _ = fuzzy_entries(items, view=view, k=k, min_tokens=min_tokens)
    total = entries.agg(F.coalesce(F.sum(token_count(F.col("line"))), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_shingles))
    source = spread(docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    out = None
    for b in range(blocks):
        mine = entries if blocks == 1 else entries.where(F.pmod(F.xxhash64("line"), F.lit(blocks)) == b)
        rows = [(list(r["item_ids"]), r["line"]) for r in mine.orderBy("line").select("item_ids", "line").toLocalIterator()]
        index = FuzzyIndex(rows, k, hashes, bands, seed)

        def run(batches: Iterator[pa.RecordBatch], index: FuzzyIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for e, m, s in index.scan(tokens_of(text), least, min_shared):
                        found += [(i, doc, m / len(index.sets[e]), m, len(index.sets[e]), s) for i in index.ids[e]]
                kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array([r[c] for r in found], t) for c, t in enumerate(kinds)], HITS.names)

        part = source.mapInArrow(run, HITS)
        out = part if out is None else out.unionByName(part)
    return out

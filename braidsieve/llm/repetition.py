"""The share of a document that repeats itself (problem 8).

A document is a sequence of lines (long lines are parted at sentence ends and after ``LINE_WORDS`` words).  A
linear-chain conditional random field labels each line as content or as boilerplate, that is as a repetition of earlier
text of the same document, by Viterbi decoding; the share of words left in content lines decides retention.  The exact
share of repeated k-runs comes out beside it.

A line's features are how many of its words, pairs and triples of words stand earlier in the document (by steps), whether
it opens as an earlier line does, whether all of it stands earlier, and whether it is short.  The field is fitted here, by
gradient ascent on the conditional likelihood, on ``FIT_PAGES`` generated pages with a fixed seed, whose lines are
labelled by how they were made: a line is boilerplate if at least a quarter of it was copied.  ``retention_cut`` is chosen
on ``CUT_PAGES`` other generated pages: the greatest content share of any of them that repeats enough, and ``MARGIN``
more.  Neither ever looks at the data.

Defined results: null, empty and wordless texts have no words, content share 1 and repeated share 0.  Runs are told
apart by 64-bit hashes within one document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidsieve.llm import text as tx
from braidsieve.session import spread

LINE_WORDS = 32
FIT_PAGES = 200
CUT_PAGES = 2000
MARGIN = 0.1
LEAST, LEAST_WORDS = 0.3, 20
_BREAKS = ("\n", ".", "!", "?")


# ---------------------------------------------------------------- the field


STEPS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999)


def line_features(codes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """lines x features; codes: the words of documents one after another, start: where each line begins."""
    n = len(codes)
    lengths = np.diff(np.append(start, n))
    line = np.repeat(np.arange(len(start)), lengths)
    cols = [np.ones(len(start))]
    opens = np.zeros(len(start), bool)
    for k in (1, 2, 3):
        at, key = run_keys(codes, doc, k)
        again = _seen_before(key)
        own = np.bincount(line[at], minlength=len(start))
        share = np.bincount(line[at], weights=again, minlength=len(start)) / np.maximum(own, 1)
        cols += [share > step for step in STEPS]
        if k == 3:
            whole = np.zeros(n, bool)
            whole[at] = again
            opens = whole[start] if n else opens
    place = np.arange(n) - np.repeat(start, lengths)
    with np.errstate(over="ignore"):
        summed = np.add.reduceat(_mix(_mix(codes) ^ _mix(place)), start) if n else np.empty(0, np.uint64)
    copy = _seen_before(_mix(summed ^ _mix(doc[start])))
    return np.stack([*cols, opens, copy, lengths < 5], axis=1).astype(np.float64)


def viterbi(emit: np.ndarray, move: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of many sequences that stand one after another; emit: lines x 2, move: 2 x 2."""
    out = np.zeros(len(emit), np.int8)
    starts = np.cumsum(lengths) - lengths
    by = np.argsort(-lengths, kind="stable")
    by = by[lengths[by] > 0]
    longest = int(lengths.max()) if len(lengths) else 0
    score = np.zeros((len(by), 2))
    back: list[np.ndarray] = []
    alive = np.searchsorted(-lengths[by], -np.arange(longest), side="left")  # sequences longer than t come first
    for t in range(longest):
        n = alive[t]
        e = emit[starts[by[:n]] + t]
        if t == 0:
            score[:n] = e
            back.append(np.empty((0, 2), np.int8))
            continue
        via = score[:n, :, None] + move[None]
        back.append(via.argmax(axis=1).astype(np.int8))
        score[:n] = via.max(axis=1) + e
    label = score.argmax(axis=1).astype(np.int8)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        out[starts[by[:n]] + t] = label[:n]
        if t:
            label[:n] = back[t][np.arange(n), label[:n]]
    return out


def _page(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, line starts and labels of a generated page: fresh lines, lines copied from earlier ones with edits, and lines
    of one phrase again and again, over vocabularies of several sizes."""
    top = int(rng.choice([400, 3000, 20000]))
    weights = 1 / (np.arange(top) + 10.0)
    weights = np.cumsum(weights / weights.sum())

    def fresh(n: int) -> np.ndarray:
        return np.searchsorted(weights, rng.random(n)).astype(np.int64)

    stock = [fresh(int(rng.integers(3, 7))) for _ in range(3)]
    rate, phrases = rng.choice([0.0, 0.03, 0.15, 0.4]), rng.choice([0.0, 0.0, 0.1])
    lines: list[np.ndarray] = []
    label: list[int] = []
    now = False
    for i in range(int(rng.integers(2, 45))):
        now = i > 0 and rng.random() < (0.7 if now else rate)
        size = int(rng.integers(2, LINE_WORDS + 1))
        if now:
            new = lines[int(rng.integers(i)) if rng.random() < 0.6 else 0].copy()
            edits = rng.integers(0, len(new), int(rng.integers(0, 5)))
            new[edits] = fresh(len(edits))
            copied = 1 - len(np.unique(edits)) / len(new)
        elif rng.random() < phrases:
            unit = fresh(int(rng.integers(2, 8)))
            new = np.resize(unit, max(size, 2 * len(unit)))[:LINE_WORDS]
            copied = 1 - len(unit) / len(new)
        else:
            new, copied = fresh(size), 0.0
            if rng.random() < 0.15:
                phrase = stock[int(rng.integers(3))]
                new = np.concatenate([new[: size // 2], phrase, new[size // 2 :]])[:LINE_WORDS]
                copied = min(1.0, len(phrase) / len(new))
        lines.append(new)
        label.append(int(copied >= 0.25))
    lengths = np.array([len(x) for x in lines])
    return np.concatenate(lines), np.cumsum(lengths) - lengths, np.array(label, np.int64)


@cache
def line_model(seed: int = 20, rounds: int = 160, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2) and moves (2 x 2), fitted by forward-backward gradients on generated pages."""
    rng = np.random.default_rng(seed)
    made = [_page(rng) for _ in range(FIT_PAGES)]
    pages = [(line_features(codes, np.zeros(len(codes), np.int64), start), y) for codes, start, y in made]
    longest, width = max(len(y) for _, y in pages), pages[0][0].shape[1]
    x = np.zeros((FIT_PAGES, longest, width))
    y = np.zeros((FIT_PAGES, longest), np.int64)
    on = np.zeros((FIT_PAGES, longest))
    for i, (a, b) in enumerate(pages):
        x[i, : len(b)], y[i, : len(b)], on[i, : len(b)] = a, b, 1
    lines = on.sum()
    w, move = np.zeros((width, 2)), np.zeros((2, 2))
    hot = np.eye(2)[y] * on[..., None]
    seen_move = np.einsum("pta,ptb->ab", hot[:, :-1], hot[:, 1:])
    vw, vm = np.zeros_like(w), np.zeros_like(move)
    for _ in range(rounds):
        e = x @ w
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + e[:, t]
        for t in range(longest - 2, -1, -1):
            nxt = np.logaddexp.reduce(move[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(on[:, t + 1, None] > 0, nxt, 0.0)
        both = alpha + beta
        z = np.logaddexp.reduce(both, axis=2, keepdims=True)
        p = np.exp(both - z) * on[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, :-1, :, None]) * on[:, 1:, None, None]
        vw = 0.9 * vw + np.einsum("ptf,pta->fa", x, hot - p) / lines - decay * w
        vm = 0.9 * vm + (seen_move - pair.sum(axis=(0, 1))) / lines - decay * move
        w, move = w + rate * vw, move + rate * vm
    return w, move


@cache
def retention_cut(k: int = 5, seed: int = 21) -> float:
    """The greatest content share of a generated page of at least ``LEAST_WORDS`` words whose repeated share is ``LEAST``
    or more, and a margin for pages unlike these: a document with more content than that is retained."""
    rng = np.random.default_rng(seed)
    pages = [_page(rng)[:2] for _ in range(CUT_PAGES)]
    sizes = np.array([len(codes) for codes, _ in pages])
    before = np.cumsum(sizes) - sizes
    start = np.concatenate([s + o for (_, s), o in zip(pages, before)])
    found = judge(np.concatenate([codes for codes, _ in pages]), np.repeat(np.arange(CUT_PAGES), sizes), start, CUT_PAGES, k, line_model())
    repeats = (found["words"] >= LEAST_WORDS) & (found["repeated"] >= LEAST * found["runs"])
    return float((found["content"] / found["words"])[repeats].max()) + MARGIN


# ---------------------------------------------------------------- documents


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seen_before(key: np.ndarray) -> np.ndarray:
    """Which keys stand earlier in the array too."""
    by = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    if len(key):
        out[by[1:]] = key[by[1:]] == key[by[:-1]]
    return out


def run_keys(codes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the k-runs within documents begin, and a number for each run of each document."""
    value, odd = _mix(codes), np.uint64(0x5851F42D4C957F2D)
    full = max(0, len(codes) - k + 1)
    run = np.zeros(full, np.uint64)
    for j in range(k):
        run = run * odd + value[j : j + full]
    at = np.flatnonzero(doc[:full] == doc[k - 1 : k - 1 + full])
    return at, _mix(run[at] ^ _mix(doc[at]))


def judge(codes: np.ndarray, doc: np.ndarray, start: np.ndarray, docs: int, k: int, model: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """words, runs, repeated (runs), content (words in content lines), lines of each of ``docs`` documents; codes: their words
    one after another, doc: each word's document, start: where lines begin."""
    lengths = np.diff(np.append(start, len(codes)))
    at, key = run_keys(codes, doc, k)
    runs = np.bincount(doc[at], minlength=docs)
    repeated = np.bincount(doc[at], weights=_seen_before(key), minlength=docs).astype(np.int64)
    w, move = model
    lines = np.bincount(doc[start], minlength=docs)
    label = viterbi(line_features(codes, doc, start) @ w, move, lines)
    content = np.bincount(doc[start], weights=(1 - label) * lengths, minlength=docs).astype(np.int64)
    return {"words": np.bincount(doc, minlength=docs), "runs": runs, "repeated": repeated, "content": content, "lines": lines}


def measure(texts: list[str | None], k: int, model: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """``judge`` of texts."""
    number: dict[str, int] = defaultdict(count(len(_BREAKS)).__next__, {b: i for i, b in enumerate(_BREAKS)})
    pieces = [tx.pieces_of(t) for t in texts]
    sizes = np.array([len(p) for p in pieces], np.int64)
    codes = np.fromiter(map(number.__getitem__, chain.from_iterable(pieces)), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    brk = codes < len(_BREAKS)
    line = np.cumsum(brk)[~brk]
    doc, codes = doc[~brk], codes[~brk]
    n = len(codes)
    new = np.ones(n, bool)
    new[1:] = (np.diff(line) != 0) | (np.diff(doc) != 0)
    start = np.flatnonzero(new)
    inside = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    new |= inside % LINE_WORDS == 0
    return judge(codes, doc, np.flatnonzero(new), len(texts), k, model)


SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("words", "lines", "runs", "repeated_runs")] + [T.StructField(c, T.DoubleType()) for c in ("repeated_share", "content_share")])


def repetition(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, batch_docs: int = 2000, batch_chars: int = 4_000_000) -> DataFrame:
    """Rows (doc_id, words, lines, runs, repeated_runs, repeated_share, content_share), one for each document.
    Nothing is shuffled: a document is judged where it is read."""
    model = line_model()
    docs = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.parts(batch, 1, batch_docs, batch_chars):
                m = measure(part.column(1).to_pylist(), k, model)
                yield pa.record_batch(
                    [
                        part.column(0),
                        *(pa.array(m[c].astype(np.int64)) for c in ("words", "lines", "runs", "repeated")),
                        pa.array(m["repeated"] / np.maximum(m["runs"], 1)),
                        pa.array(np.where(m["words"] > 0, m["content"] / np.maximum(m["words"], 1), 1.0)),
                    ],
                    ["doc_id", *SCHEMA.names],
                )

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *SCHEMA.fields]))


def not_retained(measured: DataFrame, cut: float | None = None) -> DataFrame:
    """The documents that the field alone turns away: enough words and too little content."""
    return measured.where((F.col("words") >= LEAST_WORDS) & (F.col("content_share") <= F.lit(retention_cut() if cut is None else cut)))


def repetitive(documents: DataFrame, *, least: float = LEAST, **how) -> DataFrame:
    """The documents that are not retained, held against the exact share of repeated runs."""
    return not_retained(repetition(documents, **how)).where(F.col("repeated_runs") >= F.lit(least) * F.col("runs") - 1e-9)

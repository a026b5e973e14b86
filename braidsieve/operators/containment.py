"""How much of each item stands in each document: set containment of word n-grams.

    containment(item, document) = distinct n-grams of the item found in the document / distinct n-grams of the item

Items with equal tokens share an entry; items of fewer than n tokens are matched by their whole length; n-grams of many
entries can be dropped as stop grams.

A pair's containment can only be c or more if, of any (total - ceil(c * total) + 1) n-grams of the entry, one stands in the
document.  The rarest ones are taken, so that grams that many items share do not blow the search up.

An index of at most ``block_grams`` n-grams is sent to the tasks, and each document is read, tokenized and judged once,
where it lies: nothing is shuffled.  A larger index is sent in rounds of about ``ROUND_GRAMS`` n-grams, over all documents
each, and only the hits of a round are saved: where texts have common phrases, the candidate pairs are far too many to be
rows.  ``candidates`` and ``score`` are the same by joins, for evaluations that need the pairs.  Nothing else is broadcast
unless its saved size is below the session's threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from braidsieve.functions.text import distinct_values, gram_hashes, gram_sets, sized_gram_hashes, sized_grams, slices, token_count, token_line, tokens_of
from braidsieve.operators.items import QUESTION_CHOICES, view_text
from braidsieve.scratch import Saved, save
from braidsieve.session import spread

LEVELS = ("NONE", "PARTIAL", "NEAR_DUPLICATE", "EXACT")
FLOOR = 1e-9
SHARED = 4  # so many rare n-grams a pair must have in common, if its containment asks for as many
ROUND_GRAMS = 2_000_000


@dataclass(frozen=True)
class Thresholds:
    """Least containment of a partial overlap and of a near-duplicate."""

    partial: float = 0.5
    near_duplicate: float = 0.8

    def __post_init__(self) -> None:
        if not 0 < self.partial <= self.near_duplicate <= 1:
            raise ValueError(f"0 < partial <= near_duplicate <= 1 must hold, not partial={self.partial}, near_duplicate={self.near_duplicate}")


ANY_OVERLAP = Thresholds(FLOOR, 0.8)  # one shared n-gram flags an item


def level_rank(containment: Column, exact: Column, at: Thresholds) -> Column:
    """0 none, 1 partial, 2 near-duplicate, 3 exact."""
    return F.when(exact, 3).when(containment >= at.near_duplicate, 2).when(containment >= at.partial, 1).otherwise(0)


def level_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), rank)


@dataclass
class Index:
    """entries: (entry, item_ids, line, tokens, size, total, short, grams), grams from the rarest to the most common;
    skipped: (item_id, reason); grams: how many n-grams all entries have together."""

    entries: DataFrame
    skipped: DataFrame
    grams: int
    n: int
    behind: list[Saved]

    @cached_property
    def sizes(self) -> list[int]:
        """The n-gram sizes there are, at most n numbers."""
        return sorted(r["size"] for r in self.entries.select("size").distinct().collect())

    def drop(self) -> None:
        """Delete the tables behind the index."""
        for s in self.behind:
            s.drop()

    def item_ids(self) -> DataFrame:
        return self.entries.select(F.explode("item_ids").alias("item_id"))

    def summary(self) -> DataFrame:
        """indexed_items, entries, sizes and distinct (size, gram) pairs."""
        a = self.entries.agg(F.sum(F.size("item_ids")).alias("indexed_items"), F.count(F.lit(1)).alias("entries"), F.array_sort(F.collect_set("size")).alias("sizes"))
        b = self.entries.select(F.explode("grams").alias("g")).agg(F.count_distinct("g").alias("table_size"))
        return a.crossJoin(b)


def _check(n: int, min_tokens: int | None, stop_k: int | None) -> int:
    if n < 1:
        raise ValueError("n must be at least 1")
    least = min(4, n) if min_tokens is None else min_tokens
    if not 1 <= least <= n:
        raise ValueError("1 <= min_tokens <= n must hold")
    if stop_k is not None and stop_k < 2:
        raise ValueError("stop_k must be at least 2")
    return least


def entry_lines(items: DataFrame, view: str, min_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(line, tokens, item_ids) of each distinct text that is long enough, and (item_id, reason) of the items too short."""
    lines = items.select("item_id", token_line(view_text(view)).alias("line")).withColumn("tokens", token_count(F.col("line")))
    short = lines.where(F.col("tokens") < min_tokens).select("item_id", F.lit("too_short").alias("reason"))
    long = lines.where(F.col("tokens") >= min_tokens).groupBy("line", "tokens").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return long, short


def build_index(items: DataFrame, *, view: str = QUESTION_CHOICES, n: int = 8, stop_k: int | None = None, min_tokens: int | None = None, only_short: bool = False) -> Index:
    """The index of a benchmark; items that cannot be searched are reported, never dropped silently.  With ``only_short`` it is
    of the items of fewer than n tokens alone: as n-grams have sizes, the others change nothing of theirs."""
    least = _check(n, min_tokens, stop_k)
    lines, short = entry_lines(items, view, least)
    if only_short:
        lines = lines.where(F.col("tokens") < n)
    size = F.least(F.lit(n), "tokens")
    raw = save(lines.withColumn("size", size).withColumn("entry", F.monotonically_increasing_id()), "entries")
    own = sized_grams("line", "size")
    each = raw.df.select("entry", "size", F.explode(own).alias("gram"))
    counted = each.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("df"))
    kept = each.join(counted if stop_k is None else counted.where(F.col("df") < stop_k), ["size", "gram"])
    by_entry = kept.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("df", "gram")))["gram"].alias("grams"))
    full = raw.df.join(by_entry, "entry", "left")
    done = save(full.where("grams is not null").select("entry", "item_ids", "line", "tokens", "size", F.size("grams").alias("total"), (F.col("tokens") < n).alias("short"), "grams"), "index")
    stopped = full.where("grams is null").select(F.explode("item_ids").alias("item_id"), F.lit("all_stop_ngrams").alias("reason"))
    total = done.df.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    return Index(done.df, short.unionByName(stopped), total, n, [raw, done])


def adaptive_size(items: DataFrame, view: str = QUESTION_CHOICES, cap: int = 13) -> DataFrame:
    """(items, n): the 5th percentile of the items' token counts by nearest rank, at least 1 and at most ``cap``; an error
    without items."""
    lengths = items.select(token_count(token_line(view_text(view))).alias("tokens"))
    at = lengths.agg(F.count(F.lit(1)).alias("items"), F.expr("percentile_disc(0.05) within group (order by tokens)").cast("int").alias("p"))
    n = F.when(F.col("items") == 0, F.raise_error(F.lit("no items")).cast("int")).otherwise(F.greatest(F.lit(1), F.least(F.lit(cap), "p")))
    return at.select("items", n.alias("n"))


def build_adaptive_index(items: DataFrame, *, view: str = QUESTION_CHOICES, cap: int = 13) -> Index:
    """The index with n chosen by the items' lengths; short items are matched whole."""
    return build_index(items, view=view, n=adaptive_size(items, view, cap).first()["n"], min_tokens=1)


def best_window(pos: np.ndarray, gram: np.ndarray, span: int) -> tuple[int, int]:
    """pos: ascending.  The most distinct grams within any ``span`` neighbouring positions, and the position of the first found
    gram of the first such window; (0, -1) without grams.

    An occurrence counts for every window end from its own position until the window leaves it or its gram comes again,
    whichever is first, so the distinct grams at all ends are one running sum of +1 and -1."""
    m = len(pos)
    if m == 0:
        return 0, -1
    by = np.lexsort((pos, gram))
    again = np.full(m, np.iinfo(np.int64).max)
    same = gram[by[1:]] == gram[by[:-1]]
    again[by[:-1][same]] = pos[by[1:][same]]
    until = np.searchsorted(pos, np.minimum(pos + span, again), side="left")
    change = np.ones(m + 1, np.int64)
    change[m] = 0
    np.subtract.at(change, until, 1)
    distinct = np.cumsum(change)[:m]
    end = int(distinct.argmax())
    return int(distinct[end]), int(pos[np.searchsorted(pos, pos[end] - span, side="right")])


def candidates(docs: DataFrame, index: Index, floor: float) -> DataFrame:
    """(doc_key, entry): every pair whose containment may reach ``floor``."""
    need = F.greatest(F.lit(1), F.ceil(F.lit(floor) * F.col("total") - 1e-9)).cast("int")
    rare = save(index.entries.select("entry", F.explode(F.slice("grams", 1, F.col("total") - need + 1)).alias("gram")), "rare")
    index.behind.append(rare)
    grams = spread(docs.where("text is not null").select("doc_key", "text")).select("doc_key", F.explode(gram_sets("text", index.sizes)).alias("gram"))
    return grams.join(rare.df, "gram").select("doc_key", "entry").distinct()


HIT_COLUMNS = ["item_id", "doc_key", "doc_id", "level", "containment", "matched_ngrams", "total_ngrams", "ngram_size", "exact", "short", "window_start", "snippet"]


def _spread_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of starts[i] .. starts[i] + counts[i] - 1, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _groups(amounts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First and end of runs of neighbours whose amounts are about ``most`` together; a larger amount is in a run as it is."""
    at = np.flatnonzero(np.diff((np.cumsum(amounts) - amounts) // most, prepend=-1)).tolist()
    return zip(at, [*at[1:], len(amounts)])


class Block:
    """Entries of an index within a task, as arrays: numbers for their n-grams, the n-grams of every entry, and the entries by
    rare n-gram.

    A pair that reaches the floor has ``need`` of the entry's n-grams in common, so at least k of its rarest total - need + k.
    With k up to ``SHARED`` in place of one, few pairs are left to be counted out whole."""

    def __init__(self, entries: pa.Table, floor: float) -> None:
        of = {c: entries.column(c).combine_chunks() for c in ("item_ids", "line", "tokens", "size", "total", "short", "grams")}
        self.ids, self.lines = of["item_ids"], of["line"]
        self.size, self.length, self.total = (of[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "tokens", "total"))
        self.short = of["short"].to_pylist()
        self.many = pc.list_value_length(self.ids).to_numpy(zero_copy_only=False).astype(np.int64)
        self.sizes = np.unique(self.size).tolist()
        self.known, gram = np.unique(of["grams"].flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
        self.gram = gram.astype(np.int32)
        self.first = np.append(0, np.cumsum(self.total))
        self.floor = floor
        need = np.maximum(1, np.ceil(floor * self.total - 1e-9)).astype(np.int64)
        self.shared = np.minimum(need, SHARED)
        rare = self.total - need + self.shared
        gram, owner = self.gram[_spread_ranges(self.first[:-1], rare)], np.repeat(np.arange(len(self.total), dtype=np.int32), rare)
        self.rare_owner = owner[np.argsort(gram, kind="stable")]
        self.rare_first = np.append(0, np.cumsum(np.bincount(gram, minlength=len(self.known))))

    def _known(self, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, place, number) of the n-grams that some entry has, in order of document, size and place."""
        out = []
        for doc, place, value in sized_gram_hashes(tokens, self.sizes):
            number = np.minimum(np.searchsorted(self.known, value), len(self.known) - 1)
            ok = np.flatnonzero(self.known[number] == value)
            out.append((doc[ok], place[ok], number[ok]))
        doc, place, number = (np.concatenate([o[k] for o in out]) for k in range(3))
        by = np.argsort(doc, kind="stable")
        return doc[by], place[by], number[by]

    def _pairs(self, own: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, entry) of pairs with enough rare n-grams in common, in order.  own: ascending."""
        entries = len(self.total)
        starts = self.rare_first[gram]
        counts = self.rare_first[gram + 1] - starts
        # whole documents, about a million shared n-grams at a time
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out = []
        for i, j in _groups(np.add.reduceat(counts, heads), 1_000_000):
            a, b = heads[i], heads[j] if j < len(heads) else len(own)
            base = int(own[a])
            kind = np.int32 if (int(own[b - 1]) - base + 1) * entries < 2**31 else np.int64
            key = np.repeat(((own[a:b] - base) * entries).astype(kind), counts[a:b])
            key += self.rare_owner[_spread_ranges(starts[a:b], counts[a:b])]
            key.sort()
            at = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1]))
            pair = key[at].astype(np.int64)
            enough = np.diff(np.append(at, len(key))) >= self.shared[pair % entries]
            out.append(pair[enough] + base * entries)
        pairs = np.concatenate(out)
        return pairs // entries, pairs % entries

    def match(self, tokens: list[list[str]]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(document, entry, matched n-grams, their places, their numbers) of pairs whose containment reaches the floor."""
        grams = len(self.known)
        if not grams:
            return
        doc, place, number = self._known(tokens)
        there = np.unique(doc * grams + number)
        if not len(there):
            return
        every_d, every_e = self._pairs(there // grams, there % grams)
        ends = np.searchsorted(doc, np.arange(len(tokens) + 1)).tolist()
        marked = np.zeros(grams, bool)
        for o in range(0, len(every_d), 10_000):
            d, e = every_d[o : o + 10_000], every_e[o : o + 10_000]
            wanted = np.repeat(d, self.total[e]) * grams + self.gram[_spread_ranges(self.first[e], self.total[e])]
            found = there[np.minimum(np.searchsorted(there, wanted), len(there) - 1)] == wanted
            matched = np.add.reduceat(found, np.cumsum(self.total[e]) - self.total[e], dtype=np.int64)
            for i in np.flatnonzero(matched >= self.floor * self.total[e] - 1e-9).tolist():
                a, b, mine = ends[d[i]], ends[d[i] + 1], self.gram[self.first[e[i]] : self.first[e[i] + 1]]
                marked[mine] = True
                hit = np.flatnonzero(marked[number[a:b]]) + a
                marked[mine] = False
                yield int(d[i]), int(e[i]), int(matched[i]), place[hit], number[hit]


def _scan_block(block: Block, at: Thresholds, slack: float | None, snippet_chars: int):
    """Arrow batches (doc_key, doc_id, text) to hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                tokens = [tokens_of(t) for t in part.column(2).to_pylist()]
                rows, place_of, entry_of = [], [], []
                for d, e, m, place, number in block.match(tokens):
                    length, n, total = int(block.length[e]), int(block.size[e]), int(block.total[e])
                    st = int(place[0])
                    if slack is not None:
                        m, st = best_window(place, number, span_of(slack, length, n))
                    exact = m >= at.near_duplicate * total - 1e-12 and f" {block.lines[e].as_py()} " in f" {' '.join(tokens[d])} "
                    c = m / total
                    rank = 3 if exact else 2 if c >= at.near_duplicate else 1 if c >= at.partial else 0
                    if rank:
                        cut = " ".join(tokens[d][st : st + length + 3])[:snippet_chars] if snippet_chars else ""
                        rows.append((LEVELS[rank], c, m, total, n, exact, block.short[e], st, cut))
                        place_of.append(d)
                        entry_of.append(e)
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_HIT_KINDS)]
                place, entry = np.array(place_of, np.int64), np.array(entry_of, np.int64)
                many = block.many[entry]
                # a row for each item of an entry, in batches, as an entry may have many
                for a, b in _groups(many, 50_000):
                    of = np.repeat(np.arange(a, b), many[a:b])
                    docs = part.take(pa.array(place[of]))
                    yield pa.record_batch([block.ids.take(pa.array(entry[a:b])).flatten(), docs.column(0), docs.column(1), *[c.take(pa.array(of)) for c in columns]], HIT_COLUMNS)

    return run


_HIT_KINDS = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.string())
_HIT_TYPES = (T.StringType(), T.DoubleType(), T.IntegerType(), T.IntegerType(), T.IntegerType(), T.BooleanType(), T.BooleanType(), T.IntegerType(), T.StringType())


_SCORE = T.StructType([T.StructField("m", T.IntegerType()), T.StructField("st", T.IntegerType()), T.StructField("exact", T.BooleanType()), T.StructField("snippet", T.StringType())])


def _scorer(sizes: list[int], near: float, slack: float | None, snippet_chars: int, floor: float):
    @F.arrow_udf(_SCORE)
    def run(text: pa.Array, line: pa.Array, size: pa.Array, grams: pa.Array) -> pa.Array:
        texts, at = distinct_values(text)
        tokens = [tokens_of(t) for t in texts]
        doc, place, value = gram_hashes(tokens, sizes)
        ends = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        lines = [f" {' '.join(t)} " for t in tokens]
        # the entries' grams get numbers; all others share one that is never marked
        bounds, flat = grams.offsets.to_numpy().tolist(), grams.values.to_numpy(zero_copy_only=False)
        known = np.unique(flat)
        own_number = np.searchsorted(known, flat)
        number = np.minimum(np.searchsorted(known, value), max(len(known) - 1, 0))
        number = np.where(known[number] == value, number, len(known)) if len(known) else number
        marked = np.zeros(len(known) + 1, bool)
        out = []
        for i, (d, own, n) in enumerate(zip(at.to_pylist(), line.to_pylist(), size.to_pylist())):
            a, b = ends[d], ends[d + 1]
            mine = own_number[bounds[i] : bounds[i + 1]]
            marked[mine] = True
            hit = np.flatnonzero(marked[number[a:b]]) + a
            marked[mine] = False
            m, st = len(set(number[hit].tolist())), int(place[hit[0]]) if len(hit) else -1
            if m < floor * len(mine) - 1e-9:
                out.append((0, -1, False, ""))
                continue
            length = own.count(" ") + 1
            if slack is not None:
                m, st = best_window(place[hit], number[hit], span_of(slack, length, n))
            whole = m >= near * len(mine) - 1e-12 and f" {own} " in lines[d]
            cut = " ".join(tokens[d][max(st, 0) : max(st, 0) + length + 3])[:snippet_chars] if snippet_chars else ""
            out.append((m, st, whole, cut))
        return pa.StructArray.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.bool_(), pa.string()))], _SCORE.names)

    return run


def score(docs: DataFrame, index: Index, pairs: DataFrame, *, near: float, window_slack: float | None = None, snippet_chars: int = 0, floor: float = 0.0) -> DataFrame:
    """Matched grams, containment and the contiguous match (looked for from containment ``near`` on) of (doc_key, entry)
    pairs, with the entries' columns.  Pairs below ``floor`` in the whole document come out with nothing matched: no window
    of theirs can reach it."""
    both = spread(docs.select("doc_key", "doc_id", "text").join(pairs, "doc_key").join(index.entries, "entry"), docs)
    found = both.withColumn("s", _scorer(index.sizes, near, window_slack, snippet_chars, floor)("text", "line", "size", "grams"))
    return found.select(
        "item_ids", "entry", "doc_key", "doc_id", (F.col("s.m") / F.col("total")).alias("containment"), F.col("s.m").alias("matched_ngrams"), F.col("total").alias("total_ngrams"),
        F.col("size").alias("ngram_size"), "s.exact", "short", F.col("s.st").alias("window_start"), "s.snippet",
    )


def scan(docs: DataFrame, index: Index, at: Thresholds | None = None, *, window_slack: float | None = None, snippet_chars: int = 0, block_grams: int = 500_000) -> DataFrame:
    """All (item, document) overlaps at or above the thresholds: ``HIT_COLUMNS``.  With an index of more than ``block_grams``
    n-grams they are saved round by round.  The result never reads the index's tables."""
    at = at or Thresholds()
    texts = spread(docs.where("text is not null").select("doc_key", "doc_id", "text"))
    kinds = [T.StructField("item_id", T.StringType()), texts.schema["doc_key"], texts.schema["doc_id"], *[T.StructField(c, t) for c, t in zip(HIT_COLUMNS[3:], _HIT_TYPES)]]

    def judged(entries: DataFrame) -> DataFrame:
        block = Block(entries.select("item_ids", "line", "tokens", "size", "total", "short", "grams").toArrow(), at.partial)
        return texts.mapInArrow(_scan_block(block, at, window_slack, snippet_chars), T.StructType(kinds))

    if index.grams <= block_grams:
        return judged(index.entries)
    rounds = math.ceil(index.grams / ROUND_GRAMS)
    part = F.pmod(F.xxhash64("entry"), F.lit(rounds))
    made = [save(judged(index.entries.where(part == r)), "hits") for r in range(rounds)]
    return docs.sparkSession.read.schema(made[0].schema).parquet(*[s.path for s in made])


def scan_stats(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: documents, tokens, hits, malformed."""
    known = F.col("text").isNotNull()
    a = docs.agg(F.count_if(known).alias("documents"), F.coalesce(F.sum(token_count(token_line(F.col("text")))), F.lit(0)).alias("tokens"), F.count_if(~known).alias("malformed"))
    return a.crossJoin(hits.agg(F.count(F.lit(1)).alias("hits"))).select("documents", "tokens", "hits", "malformed")


def best_hit_per_item(hits: DataFrame, rank: Column, order: str) -> DataFrame:
    """The strongest hit of every item, by rank and containment, the first by ``order`` among ties."""
    w = W.Window.partitionBy("item_id").orderBy(rank.desc(), F.col("containment").desc(), F.col(order).asc())
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def span_of(slack: float, tokens: int, size: int) -> int:
    """The window's width in n-gram positions."""
    return max(1, math.ceil(slack * (tokens - size + 1)))

"""A word-level FM-index of one shard of texts, in numpy.

A shard is a sequence of word codes: 0 is any word that is no pattern word (and every text's end), 1..s are the
pattern words.  Code 0 is never searched, so its places sort by position; that keeps every comparison short and the
index exact for all patterns of codes 1..s.

* ``suffix_order``: prefix doubling, starting with three codes at once and going on only with suffixes still tied.
* ``Wavelet``: a wavelet matrix over the transformed sequence; ``rank`` answers arrays of queries at once.
* ``FMIndex.search``: backward search of many patterns of one length; ``FMIndex.locate``: positions by stepping back to
  a sampled suffix.  A row is sampled where its position is a multiple of ``every`` or where a code 0 stands before it,
  so no step ever crosses a code 0.

An empty shard and patterns that do not occur give empty results.
"""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; see the module for how code 0 sorts."""
    n = len(codes)
    if n == 0:
        return np.empty(0, np.int64)
    zero = codes == 0
    m = int(zero.sum())
    first = codes.astype(np.int64) + m  # the zeros are 1..m by position, pattern word c is m + c
    first[zero] = np.arange(1, m + 1)
    ext = np.concatenate([first, np.zeros(3, np.int64)])
    bits = max(1, int(first.max()).bit_length())
    step = max(1, min(3, 63 // bits))
    key = ext[:n].copy()
    for j in range(1, step):
        key = (key << bits) | ext[j : n + j]
    order = np.argsort(key, kind="stable")
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = np.diff(key[order]) != 0
    # rank: the place of the first row of a tied group, so that groups keep room for their members
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(starts, sizes)
    rank[n] = -1
    tied = np.repeat(sizes > 1, sizes)
    at = np.flatnonzero(tied)
    while len(at):
        suffix = order[at]
        group = rank[suffix]
        then = rank[np.minimum(suffix + step, n)]
        by = np.lexsort((then, group)) if n > 2**31 else np.argsort(group * (n + 1) + then + 1, kind="stable")
        suffix, group, then = suffix[by], group[by], then[by]
        order[at] = suffix
        cut = np.empty(len(at), bool)
        cut[0] = True
        cut[1:] = (np.diff(group) != 0) | (np.diff(then) != 0)
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(at)))
        rank[suffix] = np.repeat(at[starts], sizes)
        at = at[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order


class _Bits:
    """A bit vector with counts of ones before every 64th bit."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        own = np.packbits(bits, bitorder="little")
        packed[: len(own)] = own
        self.word = packed.view(np.uint64)
        ones = np.bitwise_count(self.word).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        low = self.word[w] & ((np.uint64(1) << r) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.word[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix: rank and access over a sequence of small codes."""

    def __init__(self, codes: np.ndarray, top: int) -> None:
        self.depth = max(1, int(top).bit_length())
        self.levels: list[tuple[_Bits, int]] = []
        now = codes.astype(np.uint32)
        for d in range(self.depth - 1, -1, -1):
            bit = ((now >> np.uint32(d)) & np.uint32(1)).astype(bool)
            self.levels.append((_Bits(bit), int(len(now) - bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each code stands among the first i of the sequence."""
        lo, hi = np.zeros_like(i), i.copy()
        for d, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels):
            one = ((code >> d) & 1).astype(bool)
            a, b = bits.rank(lo), bits.rank(hi)
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code at each place and how often it stands before that place."""
        lo, at, code = np.zeros_like(i), i.copy(), np.zeros_like(i)
        for bits, zeros in self.levels:
            one = bits.get(at)
            a, b = bits.rank(lo), bits.rank(at)
            lo = np.where(one, zeros + a, lo - a)
            at = np.where(one, zeros + b, at - b)
            code = (code << 1) | one
        return code, at - lo


class FMIndex:
    """The index of one shard; codes are 0..top.  A sequence that does not end with a 0 gets one."""

    def __init__(self, codes: np.ndarray, top: int, every: int = 8) -> None:
        if len(codes) and codes[-1]:
            codes = np.append(codes, 0)
        n = len(codes)
        self.n, self.every = n, every
        order = suffix_order(codes)
        last = np.where(order > 0, codes[order - 1], 0) if n else np.empty(0, codes.dtype)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=top + 1))]).astype(np.int64)
        self.wavelet = Wavelet(last, top)
        sampled = (order % every == 0) | (last == 0)
        self.sampled = _Bits(sampled)
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of patterns, one in each row of a matrix; a pattern with a code 0 or beyond the index's
        codes has an empty range."""
        m, k = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        top = len(self.start) - 2
        live = np.flatnonzero(((patterns > 0) & (patterns <= top)).all(axis=1)) if m else np.empty(0, np.int64)
        dead = np.ones(m, bool)
        dead[live] = False
        hi[dead] = 0
        for j in range(k - 1, -1, -1):
            if not len(live):
                break
            c = patterns[live, j].astype(np.int64)
            a = self.start[c] + self.wavelet.rank(c, lo[live])
            b = self.start[c] + self.wavelet.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[b > a]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position in the shard of each row's suffix."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            here = self.sampled.get(at)
            out[todo[here]] = self.samples[self.sampled.rank(at[here])] + steps
            todo, at = todo[~here], at[~here]
            if len(todo):
                code, before = self.wavelet.access_rank(at)
                at = self.start[code] + before
            steps += 1
        return out

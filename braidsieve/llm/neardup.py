"""Near-duplicate texts (problem 2): universal hash minima with banding, signature verification, connected components.

Texts with the same words form a class, and the first of them stands for it.  A class has ``bands x rows`` minima of
multiply-shift hashes over its k-runs, and a signature of 256 bits, two of each of 128 minima.

1. The keys of all bands go to the parts of their range, packed in sorted blocks, and only rows whose key occurs again are
   kept.  Of a key that many rows of one task share, two of them go that way; the others are known to be shared.
2. The kept rows meet in their bucket together with signatures, and only pairs whose signatures differ in few enough bits
   leave it: four and a half standard deviations more than the threshold makes likely, a loss below 1 in 10^5.
3. What is left is held against the exact Jaccard similarity of the k-runs.

No bucket is cut and none is held in one task as a whole.  A bucket of more than ``cell`` rows is parted at random into
blocks of about half of that, and each two blocks meet in a cell of their own, so that every pair is compared once and
a cell has about ``cell`` rows however many rows share the key.  These bounds are fixed numbers, no share of the data.

With the default 64 bands of 3 rows a pair exactly at 0.5 is missed with probability 0.02 %, one at 0.6 with 2 in 10^7.

Defined results: null texts and texts of fewer than k words have no k-run and are in no pair; ids that are null are left
out; repeated (id, text) rows count once; an empty table gives empty results.  k-runs are told apart by 32 bits of a
hash, so a similarity may be off by one run in one of about 2^32 / (runs of the one x runs of the other) pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidsieve.functions.text import gram_hashes
from braidsieve.llm import text as tx
from braidsieve.llm.components import connected_components
from braidsieve.operators.expand import member_pairs
from braidsieve.operators.skew import skewed_join
from braidsieve.scratch import Saved, save
from braidsieve.session import spread

SIGNED = 128  # minima that give two bits each
WORDS = 2 * SIGNED // 64
SIGNATURE = [f"s{i}" for i in range(WORDS)]


def run_sets(words: list[list[str]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-runs of texts as 32-bit numbers in order, one text after another, and where each text begins (one
    more than there are texts)."""
    text, _, run = gram_hashes(words, [k])
    both = np.unique((text.astype(np.uint64) << np.uint64(32)) | (run.view(np.uint64) >> np.uint64(32)))
    return both.astype(np.uint32), np.searchsorted(both >> np.uint64(32), np.arange(len(words) + 1, dtype=np.uint64))


def minima(runs: np.ndarray, offsets: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """count x texts: the least multiply-shift hash of each text's runs, for ``count`` hash functions; no text is empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    out = np.empty((count, len(offsets)), np.uint32)
    for j in range(count):
        out[j] = np.minimum.reduceat(runs * a[j] + b[j], offsets)
    return out


def signature_bits(m: np.ndarray) -> np.ndarray:
    """texts x words of 64 bits: two middle bits of each of the first ``SIGNED`` minima."""
    two = (m[:SIGNED] >> np.uint32(13)).astype(np.uint8)
    bits = np.concatenate([two & 1, (two >> 1) & 1]).T
    return np.packbits(bits, axis=1).reshape(len(bits), 2 * SIGNED // 8).copy().view(np.uint64)


def most_differing(least: float) -> int:
    """How many of the signatures' bits may differ: of a pair at ``least``, 1 - least of the minima are unlike, and each
    of these gives two bits of even chance."""
    apart = 1 - least
    return int(SIGNED * apart + 4.5 * (SIGNED * (1.5 * apart - apart * apart)) ** 0.5)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """bands x texts: one key for the minima of each band."""
    keys = np.empty((bands, m.shape[1]), np.uint64)
    for i in range(bands):
        h = np.full(m.shape[1], i + 1, np.uint64)
        for j in range(rows):
            h = _mix((h + np.uint64(0x9E3779B97F4A7C15)) ^ m[i * rows + j].astype(np.uint64))
        keys[i] = h
    return keys


def _read(k: int):
    """Arrow batches (id, text) to rows of texts with at least k words: id, digest of the words, signature, runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.parts(batch, 1):
                words = [tx.words_of(t) for t in part.column(1).to_pylist()]
                long = [i for i, w in enumerate(words) if len(w) >= k]
                words = [words[i] for i in long]
                if not long:
                    continue
                digests = np.frombuffer(b"".join(hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in words), np.int64).reshape(-1, 2)
                runs, offsets = run_sets(words, k)
                s = signature_bits(minima(runs, offsets[:-1], SIGNED)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(runs.view(np.int32)))
                yield pa.record_batch([part.column(0).take(pa.array(long)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists, *(pa.array(s[:, i]) for i in range(WORDS))], ["id", "d0", "d1", "runs", *SIGNATURE])

    return run


def planes(x: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then their second ones, and so on: bytes that hardly change stand together and cost
    little once they are compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


_BLOCK = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("known", T.BooleanType()), T.StructField("base", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("rows", T.BinaryType())])


def _band_blocks(bands: int, rows: int, parts: int, chunk_keys: int):
    """Arrow batches (n, runs), n ascending, to blocks of band keys (48 bits) with their rows, sorted, for each part of the
    keys' range.

    Of a key that a chunk of ``chunk_keys`` keys has more than twice, two rows go to the key's part and all others, which
    are known to stand in a shared bucket, to any part.  So a part gets two rows of a key from each chunk at most."""

    def block(part: int, known: bool, keys: np.ndarray, n: np.ndarray) -> tuple:
        base = int(n.min())
        return part, known, base, planes(keys), planes((n - base).astype(np.uint32))

    def blocks(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        # a key's 48 bits and its row's place in the chunk are sorted as one number
        both = np.sort(((keys >> np.uint64(16) << np.uint64(16)) | np.arange(len(n), dtype=np.uint64)).reshape(-1))
        key, own = both >> np.uint64(16), n[(both & np.uint64(0xFFFF)).astype(np.int64)]
        more = np.zeros(len(key), bool)
        more[2:] = key[2:] == key[:-2]
        out = []
        if more.any():
            out.append(block(int(key[0] % np.uint64(parts)), True, key[more], own[more]))
            key, own = key[~more], own[~more]
        part = ((key >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(part)) + 1
        out += [block(int(p[0]), False, k, o) for p, k, o in zip(np.split(part, cuts), np.split(key, cuts), np.split(own, cuts))]
        return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()))], _BLOCK.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for whole in batches:
            for o in range(0, whole.num_rows, 1000):
                part = whole.slice(o, 1000)
                n, lists = part.column(0).to_numpy(), part.column(1)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                runs = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint32)
                if held and (size + bands * len(n) > min(chunk_keys, bands << 16) or n[-1] - held[0][1][0] >= 1 << 32 or n[0] < held[-1][1][-1]):
                    yield blocks(np.concatenate([k for k, _ in held], axis=1), np.concatenate([x for _, x in held]))
                    held, size = [], 0
                held.append((band_keys(minima(runs, offsets[:-1] - offsets[0], bands * rows), bands, rows), n))
                size += bands * len(n)
        if held:
            yield blocks(np.concatenate([k for k, _ in held], axis=1), np.concatenate([x for _, x in held]))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of part to rows (band, n) whose key stands in more than one row."""

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n)], ["band", "n"])

    def met(keys: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.concatenate(keys), np.concatenate(rows)
        by = np.argsort(key, kind="stable")
        key, n = key[by], n[by]
        keep = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        return out(key[keep], n[keep])

    now, keys, rows = None, [], []
    for batch in batches:
        for part, known, base, k, r in zip(*(c.to_pylist() for c in batch.columns)):
            key, n = unplaned(k, np.uint64), unplaned(r, np.uint32).astype(np.int64) + base
            if known:
                yield out(key, n)
                continue
            if part != now and keys:
                yield met(keys, rows)
                keys, rows = [], []
            now = part
            keys.append(key)
            rows.append(n)
    if keys:
        yield met(keys, rows)


def _compare(least: float):
    """Rows (band, x, y, block, n, size, signature) in order of (band, x, y) to pairs (n_a, n_b) that may reach ``least``."""
    most = most_differing(least)

    def pairs_of(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        band, x, y, block, n, size = cols[:6]
        s = np.stack(cols[6:], axis=1).view(np.uint64)
        new = np.ones(len(n), bool)
        new[1:] = (band[1:] != band[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        start = np.flatnonzero(new)
        ends = np.repeat(np.append(start[1:], len(n)), np.diff(np.append(start, len(n))))
        i = np.arange(len(n))
        for d in range(1, len(n)):
            i = i[i + d < ends[i]]
            if not len(i):
                break
            j = i + d
            # a cell of two blocks compares rows of unlike blocks, a cell of one compares them all
            ok = (block[i] != block[j]) | (x[i] == y[i])
            lo, hi = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            ok &= lo >= least * hi - 1e-9
            ok &= np.bitwise_count(s[i] ^ s[j]).sum(axis=1, dtype=np.int64) <= most
            a, b = n[i[ok]], n[j[ok]]
            if len(a):
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["n_a", "n_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(p) for p in zip(rest, cols)]
            cell = np.stack(cols[:3])
            other = np.flatnonzero((cell != cell[:, -1:]).any(axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last cell may go on in the next batch
            yield from pairs_of([c[:cut] for c in cols])
            rest = [c[cut:] for c in cols]
        if rest is not None:
            yield from pairs_of(rest)

    return run


def _schema(names: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in names.split()])


@dataclass
class NearDuplicates:
    """members (id, n), class pairs (n_a, n_b, jaccard) with n_a < n_b, and the tables behind them."""

    members: DataFrame
    pairs: DataFrame
    behind: list[Saved]


def cells(shared: DataFrame, cell: int) -> DataFrame:
    """shared: (band, n, ...).  The rows with their ``block`` and the ``x`` and ``y`` of every cell they are in; a bucket of at
    most ``cell`` rows is one cell."""
    large = shared.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > cell)
    held = save(large.select("band", F.ceil(F.col("c") * 2 / cell).cast("long").alias("k")), "large")
    if not held.rows:
        held.drop()
        return shared.withColumns({c: F.lit(0).cast("long") for c in ("x", "y", "block")})
    placed = shared.join(held.df, "band", "left").withColumn("block", F.when(F.col("k").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("n"), F.col("k"))))
    every = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("k", F.lit(1)) - 1)))
    return every.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("k", "other")


def near_duplicates(df: DataFrame, id: str, text: str, *, k: int = 5, least: float = 0.8, bands: int = 64, rows: int = 3, cell: int = 1024, part_keys: int = 1 << 21) -> NearDuplicates:
    """Classes of equal words and all pairs of classes with Jaccard similarity of k-runs of at least ``least``."""
    if not 0 < least <= 1:
        raise ValueError("least must be within (0, 1]")
    if cell < 2:
        raise ValueError("a cell needs at least 2 rows")
    source = spread(df.select(F.col(id).alias("id"), F.col(text).alias("text"))).where("id is not null and text is not null")
    long = [T.StructField(c, T.LongType()) for c in ("d0", "d1")]
    made = source.mapInArrow(_read(k), T.StructType([source.schema["id"], *long, T.StructField("runs", T.ArrayType(T.IntegerType())), *[T.StructField(c, T.LongType()) for c in SIGNATURE]]))
    held = save(made.withColumn("n", F.monotonically_increasing_id()), "texts")

    # rows that are not the first of their class, with the row that is
    several = save(held.df.groupBy("d0", "d1").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"), "several")
    same = skewed_join(held.df.select("n", "d0", "d1"), several.df, ["d0", "d1"], "c", held.rows)
    copies = save(same.where("n <> first").select("n", "first"), "copies")
    members = save(held.df.select("id", "n").join(copies.df, "n", "left").select("id", F.coalesce("first", "n").alias("n")).distinct(), "members")
    classes = held.df.join(copies.df, "n", "left_anti")

    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-held.rows * bands // part_keys))
    blocks = classes.select("n", "runs").mapInArrow(_band_blocks(bands, rows, wanted, part_keys), _BLOCK)
    shared = save(blocks.repartition("part").sortWithinPartitions("part").mapInArrow(_shared, _schema("band n")), "shared")

    signed = shared.df.join(classes.select("n", F.size("runs").cast("long").alias("size"), *SIGNATURE), "n")
    cols = ["band", "x", "y", "block", "n", "size", *SIGNATURE]
    laid = cells(signed, cell).select(cols).repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    candidates = laid.mapInArrow(_compare(least), _schema("n_a n_b")).distinct()

    left = held.df.select(F.col("n").alias("n_a"), F.col("runs").alias("runs_a"))
    right = held.df.select(F.col("n").alias("n_b"), F.col("runs").alias("runs_b"))
    common = F.size(F.array_intersect("runs_a", "runs_b"))
    checked = candidates.join(left, "n_a").join(right, "n_b").select("n_a", "n_b", common.alias("c"), (F.size("runs_a") + F.size("runs_b")).alias("s"))
    true = checked.select("n_a", "n_b", (F.col("c") / (F.col("s") - F.col("c"))).alias("jaccard")).where(F.col("jaccard") >= F.lit(least) - 1e-12)
    pairs = save(true, "pairs")
    for done in (held, several, copies, shared):
        done.drop()
    return NearDuplicates(members.df, pairs.df, [members, pairs])


def id_pairs(found: NearDuplicates, block: int = 4096) -> DataFrame:
    """(id_a, id_b, jaccard), id_a < id_b, of all ids in one class or in a pair of classes: as many rows as there are pairs of
    ids, m (m - 1) / 2 of a class of m.  ``groups`` says the same in one row for each id."""
    sizes = found.members.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    links = found.pairs.unionByName(sizes.where("c > 1").select(F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.lit(1.0).alias("jaccard")))
    both = member_pairs(links, found.members, ["n"], "id", sizes, block).where("n_a <> n_b or id_a < id_b").where("id_a <> id_b")
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "jaccard")


def groups(found: NearDuplicates) -> DataFrame:
    """One row for each id: (id, class_id, group_id, links): class and group are named by their least id; links counts the
    other classes that the id's class is linked with."""
    nodes, stars = connected_components(found.pairs, "n_a", "n_b")
    found.behind.append(stars)
    links = found.pairs.select(F.col("n_a").alias("n")).unionByName(found.pairs.select(F.col("n_b").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("links"))
    classes = found.members.groupBy("n").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("c"))
    placed = classes.join(nodes, F.col("n") == F.col("node"), "left").select("n", "c", "class_id", F.coalesce("component", "n").alias("g"))
    names = placed.groupBy("g").agg(F.min("class_id").alias("group_id"), F.count(F.lit(1)).alias("in"))
    total = found.members.count()
    named = save(skewed_join(placed, names, ["g"], "in", total).join(links, "n", "left").select("n", "c", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links")), "named")
    found.behind.append(named)
    return skewed_join(found.members, named.df, ["n"], "c", total).select("id", "class_id", "group_id", "links")


def reconcile(listed: DataFrame, found: NearDuplicates, tolerance: float = 0.006) -> DataFrame:
    """The list (id_a, id_b, jaccard) in line with what was found: (id_a, id_b, jaccard, listed_jaccard, status); status is
    kept, rescored (its score was missing or off), removed (it does not hold) or added.  Added are the links that the list
    lacks: of two classes, by their least ids, if no listed pair shows it; and of a class, by its least id and each other id
    of it, so that the copies of one text add as many rows as there are copies.  Ids are read trimmed and in lower case; nulls and self-pairs hold
    nothing and are left out; of repeated pairs the greatest valid score counts."""
    ids = [F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")) for c in ("id_a", "id_b")]
    score = F.when(F.col("jaccard").between(0.0, 1.0) & ~F.isnan("jaccard"), F.col("jaccard"))
    old = listed.select(F.least(*ids).alias("id_a"), F.greatest(*ids).alias("id_b"), score.alias("s"), *[i.isNull().alias(f"null_{j}") for j, i in enumerate(ids)])
    old = old.where("not null_0 and not null_1 and id_a <> id_b").groupBy("id_a", "id_b").agg(F.max("s").alias("listed_jaccard"))
    of = found.members
    known = (
        old.join(of.select(F.col("id").alias("id_a"), F.col("n").alias("x")), "id_a", "left")
        .join(of.select(F.col("id").alias("id_b"), F.col("n").alias("y")), "id_b", "left")
        .withColumns({"n_a": F.least("x", "y"), "n_b": F.greatest("x", "y")})
        .join(found.pairs, ["n_a", "n_b"], "left")
        .withColumn("jaccard", F.when(F.col("x") == F.col("y"), 1.0).otherwise(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("jaccard"))))
    )
    close = F.abs(F.col("jaccard") - F.col("listed_jaccard")) <= tolerance
    status = F.when(F.col("jaccard").isNull(), "removed").when(close, "kept").otherwise("rescored")
    held = save(known.select("id_a", "id_b", "x", "y", "n_a", "n_b", "jaccard", "listed_jaccard", status.alias("status")), "listed")
    found.behind.append(held)
    sizes = found.members.groupBy("n").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("c"))
    shown = held.df.where("jaccard is not null")
    far = found.pairs.join(shown.where("x <> y").select("n_a", "n_b").distinct(), ["n_a", "n_b"], "left_anti")
    name = [sizes.select(F.col("n").alias(f"n_{s}"), F.col("class_id").alias(f"c_{s}")) for s in "ab"]
    new = far.join(name[0], "n_a").join(name[1], "n_b").select(F.least("c_a", "c_b").alias("id_a"), F.greatest("c_a", "c_b").alias("id_b"), "jaccard")
    star = skewed_join(found.members, sizes.where("c > 1"), ["n"], "c", found.members.count()).where("id <> class_id").select(F.col("class_id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("jaccard"))
    near = star.join(shown.select("id_a", "id_b"), ["id_a", "id_b"], "left_anti").select("id_a", "id_b", "jaccard")
    added = new.unionByName(near).select("*", F.lit(None).cast("double").alias("listed_jaccard"), F.lit("added").alias("status"))
    return held.df.select("id_a", "id_b", "jaccard", "listed_jaccard", "status").unionByName(added)

"""Fill sequences of fixed capacity with whole documents (problem 6).

Sizes are tokens of a public tokenizer.  Documents are spread by a hash of their id over shards of about
``shard_docs``; each shard is packed online by the sum of squares: a document goes to the fill level that makes the sum
over levels of (number of partly filled sequences at that level) squared least, levels being tracked in an array.
Sequences still open at a shard's end are taken apart once more and their documents packed best-fit, largest first, so
that little of them stays empty.  A document longer than a sequence is cut into whole sequences and a rest; no other is
cut.

Documents without tokens (null or empty text) come out with piece 0, 0 tokens and no sequence.  Repeated ids are packed
one by one.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidsieve.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the default rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str, pattern: str):
    """The tokenizer of a rank file, loaded once in each Python process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens); 0 for null texts.  The rank file is read on the driver and sent to the workers by Spark."""
    docs = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    docs.sparkSession.sparkContext.addFile(path)  # a file added before is not sent again
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(SparkFiles.get(name), pattern).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType())]))


def sum_of_squares(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """The sequence of each item, packed online in the given order; sizes are 1..capacity.  Also their number."""
    level = np.zeros(capacity + 1, np.int64)  # level[h]: sequences filled to h; the full ones are not counted
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made = np.empty(len(sizes), np.int64), 0
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes):
        here = level[1 : capacity - s + 1]
        after = level[s + 1 : capacity + 1]
        gain = np.where(here > 0, 2 * (after - here) + 2, far)
        if len(gain):
            if here[-1] > 0:  # it fills the sequence: one partly filled level less, none more
                gain[-1] = 1 - 2 * here[-1]
            best = len(gain) - 1 - int(gain[::-1].argmin())  # of equal ones the fullest
            old = gain[best]
        else:
            old = far
        fresh = 2 * level[s] + 1 if s < capacity else 0
        if old != far and old <= fresh:
            h = best + 1
            b = at[h].pop()
            level[h] -= 1
        else:
            h, b = 0, made
            made += 1
        out[i] = b
        if h + s < capacity:
            level[h + s] += 1
            at[h + s].append(b)
    return out, made


def _repack(sizes: np.ndarray, bins: np.ndarray, made: int, capacity: int) -> np.ndarray:
    """Take the sequences that are not full apart and pack their items best-fit, largest first."""
    fill = np.bincount(bins, weights=sizes, minlength=made).astype(np.int64)
    open_ = fill < capacity
    items = np.flatnonzero(open_[bins])
    items = items[np.argsort(-sizes[items], kind="stable")]
    free = np.flatnonzero(open_).tolist()[::-1]
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    have = np.zeros(capacity + 1, bool)  # have[r]: some sequence has room r
    out, most = bins.copy(), made
    for i in items.tolist():
        s = int(sizes[i])
        r = int(have[s:].argmax()) + s
        if have[r]:
            b = at[r].pop()
            have[r] = bool(at[r])
        else:
            r = capacity
            if free:
                b = free.pop()
            else:
                b, most = most, most + 1
        out[i] = b
        at[r - s].append(b)
        have[r - s] = r > s
    return out


def pack_shard(tokens: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """own (the document's place in ``tokens``), piece, n_tokens, bin and start of every piece of one shard; bins are
    numbered from 0 without gaps, -1 where there are no tokens."""
    tokens = np.asarray(tokens, np.int64)
    pieces = np.maximum(1, -(-tokens // capacity))
    own = np.repeat(np.arange(len(tokens)), pieces)
    piece = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(capacity, tokens[own] - piece * capacity)
    some = np.flatnonzero(size > 0)
    bins, made = sum_of_squares(size[some].tolist(), capacity)
    if len(some):
        bins = _repack(size[some], bins, made, capacity)
        bins = np.unique(bins, return_inverse=True)[1]
    by = np.argsort(bins, kind="stable")
    run = np.cumsum(size[some][by]) - size[some][by]
    first = np.ones(len(by), bool)
    first[1:] = np.diff(bins[by]) != 0
    start = np.empty(len(by), np.int64)
    start[by] = run - np.repeat(run[first], np.diff(np.append(np.flatnonzero(first), len(by)))) if len(by) else run
    full_bin, full_start = np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64)
    full_bin[some], full_start[some] = bins, start
    return {"own": own, "piece": piece, "n_tokens": size, "bin": full_bin, "start": full_start}


def pack(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, shard_docs: int = 20_000, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, piece, n_tokens, sequence, start): every document's place; ``sequence`` is unique over all shards.  There is a
    partition for each shard, so shards are packed side by side."""
    if capacity < 1 or shard_docs < 1:
        raise ValueError("capacity and shard_docs must be at least 1")
    shards = max(1, math.ceil(documents.count() / shard_docs))
    sized = count_tokens(documents, doc_id=doc_id, text=text, path=path, pattern=pattern)
    sharded = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).cast("int"))

    def one(table: pa.Table) -> pa.Table:
        # rows that agree in id and size are alike, so the order within a shard is fixed
        table = table.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        shard = table.column("shard")[0].as_py()
        out = pack_shard(table.column("n_tokens").to_numpy(), capacity)
        sequence = pa.array(out["bin"] + (shard << 32), pa.int64(), mask=out["bin"] < 0)
        return pa.table([table.column("doc_id").take(pa.array(out["own"])), pa.array(out["piece"]), pa.array(out["n_tokens"]), sequence, pa.array(out["start"])], ["doc_id", "piece", "n_tokens", "sequence", "start"])

    kind = sized.schema["doc_id"]
    fields = [T.StructField(c, T.LongType()) for c in ("piece", "n_tokens", "sequence", "start")]
    return sharded.repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(one, T.StructType([kind, *fields]))


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: sequences, tokens, and the share of room left unused."""
    return packed.agg(F.count_distinct("sequence").alias("sequences"), F.sum("n_tokens").alias("tokens")).select(
        "sequences", "tokens", (1 - F.col("tokens") / (F.col("sequences") * capacity)).alias("unused_share")
    )


def faults(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: documents (ids are unique here), overfull sequences, sequences with gaps or overlaps, documents cut though they
    fit into one sequence, and pieces with tokens but no place."""
    own = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("t"), F.count_if(F.col("sequence").isNull() & (F.col("n_tokens") > 0)).alias("lost"))
    docs = own.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= capacity)).alias("cut_in_vain"), F.sum("lost").alias("unplaced"))
    filled = packed.where("sequence is not null").groupBy("sequence").agg(F.sum("n_tokens").alias("t"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.count(F.lit(1)).alias("n"), F.count_distinct("start").alias("starts"))
    seqs = filled.agg(F.count_if(F.col("t") > capacity).alias("overfull"), F.count_if((F.col("end") != F.col("t")) | (F.col("n") != F.col("starts"))).alias("gaps"))
    return docs.crossJoin(seqs).select("documents", "overfull", "gaps", "cut_in_vain", "unplaced")

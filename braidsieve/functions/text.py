"""Normal form, tokens and n-gram hashes of texts, as Arrow functions over columns.

*Normal form*: format characters (Cf) deleted, NFKC, lower case, NFKC again, punctuation (P*) as spaces, white space
collapsed and trimmed.  *Tokens*: of the normal form, runs of letters, digits and underscores, or single other symbols.
NFKC has no counterpart among Spark's functions, which is why texts pass through Python once; what follows (explode, join,
aggregate) stays in the JVM.

Nulls stay null.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def character_class(points: list[int]) -> str:
    """The body of a regular expression's class for code points in ascending order."""
    out: list[str] = []
    first = last = None
    for p in [*points, None]:
        if first is not None and p != last + 1:
            out.append(f"\\U{first:08x}" if first == last else f"\\U{first:08x}-\\U{last:08x}")
            first = None
        if first is None:
            first = p
        last = p
    return "".join(out)


@cache
def _patterns() -> tuple[re.Pattern[str], re.Pattern[str], re.Pattern[str]]:
    """Format characters, punctuation, and tokens of a text whose punctuation still stands."""
    kinds: dict[str, list[int]] = defaultdict(list)
    for p in chain(range(0x20000), range(0xE0000, 0xE1000)):  # beyond these planes are only letters and unassigned points
        kinds[unicodedata.category(chr(p))].append(p)
    marks = sorted(p for k, ps in kinds.items() if k[0] == "P" for p in ps)
    marked = character_class(marks)
    return re.compile(f"[{character_class(kinds['Cf'])}]+"), re.compile(f"[{marked}]+"), re.compile(f"\\w+|[^\\w\\s{marked}]")


_TOKEN = re.compile(r"\w+|[^\w\s]")
_ASCII_MARKS = str.maketrans({c: " " for c in map(chr, range(128)) if unicodedata.category(c)[0] == "P"})


def normalize(text: str) -> str:
    """The normal form of a text; raises TypeError for anything but a string."""
    if not isinstance(text, str):
        raise TypeError(f"a text is needed, not {type(text).__name__}")
    if text.isascii():
        return " ".join(text.lower().translate(_ASCII_MARKS).split())
    unseen, marks, _ = _patterns()
    low = unicodedata.normalize("NFKC", unseen.sub("", text)).lower()
    return " ".join(marks.sub(" ", unicodedata.normalize("NFKC", low)).split())


def tokenize(normal: str) -> list[str]:
    """The tokens of a text in normal form."""
    return _TOKEN.findall(normal)


_ASCII_TOKEN = re.compile(r"[a-z0-9]+|[$+<=>^`|~\x00-\x08\x0e-\x1b\x7f]")


def tokens_of(text: str | None) -> list[str]:
    """``tokenize(normalize(text))`` in one pass; none for null."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_TOKEN.findall(text.lower())
    unseen, _, token = _patterns()
    low = unicodedata.normalize("NFKC", unseen.sub("", text)).lower()
    return token.findall(unicodedata.normalize("NFKC", low).replace("_", " "))


def distinct_values(values: pa.Array | pa.ChunkedArray) -> tuple[list[str | None], pa.Array]:
    """The distinct values of an array, and where each row's value stands among them."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    coded = values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices


def _string_function(f):
    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        texts, at = distinct_values(values)
        return pa.array([f(t) for t in texts], pa.string()).take(at)

    return run


normal_form = _string_function(normalize)
token_line = _string_function(lambda t: " ".join(tokens_of(t)))


def token_count(line: Column) -> Column:
    """Tokens of a token line."""
    return F.when(F.length(line) == 0, F.lit(0)).otherwise(F.size(F.split(line, " ")))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_values(tokens: list[str]) -> np.ndarray:
    """A 64-bit hash of each token, taken once for each distinct one."""
    try:
        coded = pa.array(tokens, pa.string()).dictionary_encode()
    except UnicodeEncodeError:  # half of a surrogate pair, which no Arrow text holds
        return np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens], np.uint64)
    own = np.array([xxhash.xxh64_intdigest(t.encode()) for t in coded.dictionary.to_pylist()], np.uint64)
    return own[coded.indices.to_numpy()]


def sized_gram_hashes(tokens: list[list[str]], sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position, hash) of every n-gram, an array for each size, in order of text and position.  A hash names a size and
    its tokens; texts shorter than a size have none of it."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    value = token_values(list(chain.from_iterable(tokens)))
    text = np.repeat(np.arange(len(tokens)), lengths)
    place = np.arange(len(value)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    for n in sizes:
        full = max(0, len(value) - n + 1)
        h = np.full(full, n, np.uint64)
        for j in range(n):
            h = _mix((h + np.uint64(0x9E3779B97F4A7C15)) ^ value[j : j + full])
        at = np.flatnonzero(text[:full] == text[n - 1 : n - 1 + full])
        yield text[at], place[at], h[at].view(np.int64)


def gram_hashes(tokens: list[list[str]], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of every n-gram of every size, in order of text, size and position."""
    out = list(sized_gram_hashes(tokens, sizes))
    docs, places, hashes = (np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3))
    by = np.argsort(docs, kind="stable")
    return docs[by], places[by], hashes[by]


GRAM = T.StructType([T.StructField("line", T.StringType()), T.StructField("grams", T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("gram", T.LongType())])))])


def gram_sets(text: Column | str, sizes: list[int]) -> Column:
    """The distinct n-gram hashes of the given sizes; none for null."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(values: pa.Array) -> pa.Array:
        texts, at = distinct_values(values)
        doc, _, gram = gram_hashes([tokens_of(t) for t in texts], sizes)
        by = np.lexsort((gram, doc))
        doc, gram = doc[by], gram[by]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
        ends = np.searchsorted(doc[new], np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(gram[new])).take(at)

    return run(F.col(text) if isinstance(text, str) else text)


def sized_grams(text: Column | str, size: Column | str) -> Column:
    """The distinct n-gram hashes of each row's own size; none for null."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(values: pa.Array, sizes: pa.Array) -> pa.Array:
        tokens, own = [tokens_of(t) for t in values.to_pylist()], np.array(sizes.to_pylist())
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(tokens)
        for n in set(own.tolist()):
            rows = np.flatnonzero(own == n)
            doc, _, gram = gram_hashes([tokens[i] for i in rows.tolist()], [n])
            ends = np.searchsorted(doc, np.arange(len(rows) + 1)).tolist()
            for j, i in enumerate(rows.tolist()):
                out[i] = np.unique(gram[ends[j] : ends[j + 1]])
        ends = np.append(0, np.cumsum([len(x) for x in out])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))

    return run(*(F.col(c) if isinstance(c, str) else c for c in (text, size)))


def slices(batch: pa.RecordBatch, text: int, rows: int = 2000, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and about ``chars`` characters of column ``text``; a longer text is a slice
    by itself."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    o = 0
    while o < batch.num_rows:
        most = int(np.searchsorted(ends, (ends[o - 1] if o else 0) + chars, side="right"))
        part = batch.slice(o, max(1, min(rows, most - o)))
        o += part.num_rows
        yield part


def with_grams(text: Column | str, sizes: list[int]) -> Column:
    """A struct of the token line and of all n-grams of the given sizes: grams of (pos, gram)."""
    if not sizes or min(sizes) < 1:
        raise ValueError("n-grams need sizes of at least 1")

    @F.arrow_udf(GRAM)
    def run(values: pa.Array) -> pa.Array:
        texts, at = distinct_values(values)
        tokens = [tokens_of(t) for t in texts]
        doc, place, gram = gram_hashes(tokens, sizes)
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        own = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(gram)], ["pos", "gram"])
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), own)
        lines = pa.array([None if t is None else " ".join(k) for t, k in zip(texts, tokens)], pa.string())
        return pa.StructArray.from_arrays([lines, lists], ["line", "grams"]).take(at)

    return run(F.col(text) if isinstance(text, str) else text)

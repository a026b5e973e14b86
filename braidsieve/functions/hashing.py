"""Stable hashes: token and n-gram values below 2**61 - 1, unit-interval keys, digests, and seeded random streams."""

from __future__ import annotations

import hashlib
import random
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The Mersenne prime that bounds hashes.
PRIME = (1 << 61) - 1


def _blake(key: str) -> bytes:
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def token_hash(token: str) -> int:
    """64 bits of BLAKE2b, big-endian, modulo 2**61 - 1."""
    return int.from_bytes(_blake(token), "big") % PRIME


def unit_interval(seed: int, key: str) -> float:
    """A number in [0, 1) that depends on the seed and the key alone."""
    return int.from_bytes(_blake(f"{seed}|{key}"), "big") / 2.0**64


def text_digest(text: str) -> str:
    return _blake(text).hex()


def stream(seed: int, *parts: str) -> random.Random:
    """A random stream that depends on the seed and the parts alone, so no record depends on any other."""
    return random.Random(int.from_bytes(_blake("|".join([str(seed), *parts])), "big"))


def unit_column(seed: int, key: Column) -> Column:
    """``unit_interval`` over a column; null stays null."""

    @F.arrow_udf(T.DoubleType())
    def run(keys: pa.Array) -> pa.Array:
        return pa.array([None if k is None else unit_interval(seed, k) for k in keys.to_pylist()], pa.float64())

    return run(key)


def digest_column(text: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else text_digest(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def token_hash_column(token: Column) -> Column:
    @F.arrow_udf(T.LongType())
    def run(tokens: pa.Array) -> pa.Array:
        return pa.array([None if t is None else token_hash(t) for t in tokens.to_pylist()], pa.int64())

    return run(token)


# Fixed value: the base of the n-gram polynomial.
GRAM_BASE = 0x1D2F3A4B5C6D7E8


def gram_values(tokens: list[str], n: int) -> list[int]:
    """Horner's polynomial over the token hashes of every n neighbouring tokens; none if there are fewer than n."""
    if n < 1:
        raise ValueError("n must be at least 1")
    values = [token_hash(t) for t in tokens]
    if len(values) < n:
        return []
    # with the polynomial of every prefix, a window is the difference of two of them
    prefix = list(accumulate(values, lambda h, v: (h * GRAM_BASE + v) % PRIME, initial=0))
    top = pow(GRAM_BASE, n, PRIME)
    return [(b - a * top) % PRIME for a, b in zip(prefix, prefix[n:])]


def gram_value_column(line: Column, n: int) -> Column:
    """``gram_values`` of a token line."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(lines: pa.Array) -> pa.Array:
        return pa.array([None if x is None else gram_values(x.split(), n) for x in lines.to_pylist()], pa.list_(pa.int64()))

    return run(line)

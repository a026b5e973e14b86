"""Statistics as column expressions, with plain counterparts for the driver."""

from __future__ import annotations

import math
from itertools import accumulate, repeat

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k of n; (0, 1) where n is 0, exact ends at k = 0 and k = n; an error for inconsistent counts."""
    p, d = k / n, 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    bad = F.raise_error(F.lit("counts must satisfy 0 <= k <= n")).cast("double")
    wrong = (k < 0) | (n < 0) | (k > n)
    low = F.when(wrong, bad).when((n == 0) | (k == 0), 0.0).otherwise(F.greatest(F.lit(0.0), mid - half))
    high = F.when(wrong, bad).when((n == 0) | (k == n), 1.0).otherwise(F.least(F.lit(1.0), mid + half))
    return low, high


def wilson_interval(k: int, n: int, z: float = 1.96) -> tuple[float, float]:
    """The same for plain numbers."""
    if not 0 <= k <= n:
        raise ValueError(f"counts must satisfy 0 <= k <= n, not k={k}, n={n}")
    if n == 0:
        return 0.0, 1.0
    d = 1 + z * z / n
    mid = (k / n + z * z / (2 * n)) / d
    half = z * math.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / d
    return (0.0 if k == 0 else max(0.0, mid - half)), (1.0 if k == n else min(1.0, mid + half))


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column, Column]:
    """Difference of two shares with its hybrid-score interval; null where there is nothing to have a share of."""
    (l1, h1), (l2, h2) = wilson(k1, n1), wilson(k2, n2)
    p1, p2 = k1 / F.nullif(n1, F.lit(0)), k2 / F.nullif(n2, F.lit(0))
    low = p1 - p2 - F.sqrt((p1 - l1) * (p1 - l1) + (h2 - p2) * (h2 - p2))
    high = p1 - p2 + F.sqrt((h1 - p1) * (h1 - p1) + (p2 - l2) * (p2 - l2))
    return p1 - p2, low, high


def candidate_probability(s: Column, bands: int, rows: int) -> Column:
    """The chance that banding makes a pair of similarity s a candidate."""
    return 1 - F.pow(1 - F.pow(s, F.lit(rows)), F.lit(bands))


def lsh_threshold(bands: int, rows: int) -> float:
    """The similarity at which the chance rises most steeply, about."""
    return (1 / bands) ** (1 / rows)


def best_banding(threshold: float, hashes: int) -> tuple[int, int]:
    """(bands, rows) whose threshold is the largest not above the given one, else the smallest there is."""
    shapes = [(b, hashes // b) for b in range(1, hashes + 1) if hashes % b == 0]
    below = [s for s in shapes if lsh_threshold(*s) <= threshold]
    return max(below, key=lambda s: lsh_threshold(*s)) if below else min(shapes, key=lambda s: lsh_threshold(*s))


def window_size(shingles: int, base: int = 8, ratio: float = 1.3) -> int:
    """The least of the sizes base, base * ratio, ... (rounded up each time, growing by one at least) that holds the shingles."""
    sizes = accumulate(repeat(base), lambda s, _: max(s + 1, math.ceil(s * ratio)))
    return next(s for s in sizes if s >= shingles)

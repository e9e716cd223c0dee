"""Numeric functions: ratios, intervals, sigmoids, vector algebra."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95, Z95_SHORT = 1.959963984540054, 1.96


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within [0, 1]; null without trials."""
    n, p = F.nullif(n.cast("double"), F.lit(0.0)), ratio(hits, n)
    z2 = z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def sigmoid(z: Column) -> Column:
    """Stable on both sides: the exponent is never positive."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def bce_logits(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    """Null where the norm is zero or a component is missing or not finite."""
    norm = F.sqrt(dot(v, v))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm > 0)
    return F.when(fine, F.transform(v, lambda x: x.cast("double") / norm))


def next_after(x: Column) -> Column:
    """The next double towards infinity."""

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else math.nextafter(v, math.inf) for v in values.to_pylist()], pa.float64())

    return run(x)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 400):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for t in (up, down):
            d = 1 / (1 + t * d or 1e-300)
            c = 1 + t / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f / a


def clopper_pearson_upper(hits: int, n: int, confidence: float = 0.95) -> float:
    """One-sided exact upper bound of a rate."""
    if not 0 <= hits <= n or n < 1:
        raise ValueError("hits must lie between 0 and n, n be positive")
    if hits == n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, hits + 1, n - hits) < confidence else (low, mid)
    return (low + high) / 2


def supported_budget(n: int, most: float, confidence: float = 0.95) -> int | None:
    """The largest number of false positives among n whose bound stays within
    ``most``; None if not even zero does."""
    low, high = -1, n
    while low < high:
        mid = (low + high + 1) // 2
        if clopper_pearson_upper(mid, n, confidence) <= most:
            low = mid
        else:
            high = mid - 1
    return None if low < 0 else low

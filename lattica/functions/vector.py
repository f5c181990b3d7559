"""Vectors held in array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 1e-12) -> Column:
    """a over its length, the length no less than `least`."""
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def chi_square(a: Column, b: Column) -> Column:
    """Half the sum of (x - y)^2 / (x + y) where x + y > 0."""
    terms = F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0))
    return 0.5 * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def two_way(query: Column, best_null: Column, temperature: float = 0.01) -> Column:
    """Probability of the query against the best null text under a softmax."""
    return 1.0 / (1.0 + F.exp((best_null - query) / temperature))


def logistic(cos: Column, scale: float, bias: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(cos * scale + bias)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def interpolated(sorted_values: Column, fraction: Column | float) -> Column:
    """The quantile of a sorted array at a fraction that may differ by row, by linear interpolation."""
    h = (F.size(sorted_values) - 1) * (F.lit(fraction) if isinstance(fraction, float) else fraction)
    low = F.floor(h).cast("int")
    a, b = F.get(sorted_values, low), F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
    return a + (b - a) * (h - low)


PI = math.pi

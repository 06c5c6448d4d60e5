"""Distances between two ``array<double>`` columns (D1-D16) and moments of one (F12), as Column expressions.

Arrays of different length raise an error; a null array gives null. Degenerate results keep their
meaning: +Infinity where KL meets a zero, the largest double for disjoint Jaccard supports, 0 for
the continuous Jaccard of disjoint supports. Formulas that are reproduced with their quirks: the
Hellinger sum has no root or factor (Q7), Bhattacharyya uses a variance ratio of one (Q8).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DOUBLE = 1.7976931348623157e308
LN2 = math.log(2.0)


def total(arr: Column, start: float = 0.0) -> Column:
    return F.aggregate(arr, F.lit(start), lambda s, x: s + x)


def _zip(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    same = F.when(F.size(a) == F.size(b), a).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<double>"))
    return F.zip_with(same, b, f)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, not once for each element of an inner array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def variance(a: Column) -> Column:
    """Population variance."""
    return let(mean(a), lambda m: total(F.transform(a, lambda x: (x - m) * (x - m)))) / F.size(a)


def std(a: Column) -> Column:
    return F.sqrt(variance(a))


def covariance(a: Column, b: Column) -> Column:
    """Population covariance."""
    return let(F.struct(mean(a).alias("a"), mean(b).alias("b")), lambda m: total(_zip(a, b, lambda x, y: (x - m["a"]) * (y - m["b"])))) / F.size(a)


def correlation(a: Column, b: Column) -> Column:
    return covariance(a, b) / (std(a) * std(b))


def cosine(a: Column, b: Column) -> Column:
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))
    return 1 - total(_zip(a, b, lambda x, y: x * y)) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(_zip(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(_zip(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(_zip(a, b, lambda x, y: F.abs(x - y)))


def canberra(a: Column, b: Column) -> Column:
    return total(_zip(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) == 0, F.lit(0.0)).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of the supports (values above zero)."""
    both = total(_zip(a, b, lambda x, y: F.when((x > 0) & (y > 0), 1.0).otherwise(0.0)))
    any_ = total(_zip(a, b, lambda x, y: F.when((x > 0) | (y > 0), 1.0).otherwise(0.0)))
    return F.when(both == 0, F.lit(MAX_DOUBLE)).otherwise(1 - both / any_)


def continuous_jaccard(a: Column, b: Column) -> Column:
    low, high = total(_zip(a, b, lambda x, y: F.least(x, y))), total(_zip(a, b, lambda x, y: F.greatest(x, y)))
    return F.when(low == 0, F.lit(0.0)).otherwise(1 - low / high)


def hellinger(a: Column, b: Column) -> Column:
    return total(_zip(a, b, lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y))))


def bhattacharyya(a: Column, b: Column) -> Column:
    parts = F.struct(variance(a).alias("v1"), variance(b).alias("v2"), (mean(a) - mean(b)).alias("m"))
    return let(parts, lambda p: 0.25 * F.log(0.25 * (p["v1"] / p["v2"] + 1 + 2)) + 0.25 * (p["m"] * p["m"] / (p["v1"] + p["v2"])))


def kl(a: Column, b: Column) -> Column:
    """In bits; zeros of the first vector count nothing, a zero of the second alone gives +Infinity."""
    return total(_zip(a, b, lambda x, y: F.when(x == 0, 0.0).when(y == 0, F.lit(float("inf"))).otherwise(x * F.log(x / y)))) / LN2


def symmetric_kl(a: Column, b: Column) -> Column:
    return (kl(a, b) + kl(b, a)) / 2


def jensen_shannon(a: Column, b: Column) -> Column:
    return let(_zip(a, b, lambda x, y: (x + y) / 2), lambda m: kl(a, m) + kl(b, m)) / 2


def kolmogorov_smirnov(a: Column, b: Column) -> Column:
    """Largest gap between the empirical distributions of the two vectors, taken as samples."""
    ecdf = lambda v, x: F.size(F.filter(v, lambda y: y <= x)) / F.size(v)
    return F.array_max(F.transform(F.concat(a, b), lambda x: F.abs(ecdf(a, x) - ecdf(b, x))))


def statistical(a: Column, b: Column) -> Column:
    """One minus Pearson's correlation."""
    return -(correlation(a, b) - 1)


def student_t(a: Column, b: Column) -> Column:
    """Two-sample t statistic with unequal (sample) variances."""
    va, vb = variance(a) / (F.size(a) - 1), variance(b) / (F.size(b) - 1)
    return (mean(a) - mean(b)) / F.sqrt(va + vb)


def uber(a: Column, b: Column) -> Column:
    """Mean of Canberra, Chebyshev, cosine, Euclidean, continuous Jaccard, KL and Manhattan."""
    parts = [canberra, chebyshev, cosine, euclidean, continuous_jaccard, kl, manhattan]
    return sum((f(a, b) for f in parts[1:]), parts[0](a, b)) / len(parts)


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": cosine, "euclidean": euclidean, "manhattan": manhattan, "chebyshev": chebyshev, "canberra": canberra, "jaccard": jaccard,
    "continuous_jaccard": continuous_jaccard, "hellinger": hellinger, "bhattacharyya": bhattacharyya, "kl": kl, "symmetric_kl": symmetric_kl,
    "jensen_shannon": jensen_shannon, "kolmogorov_smirnov": kolmogorov_smirnov, "statistical": statistical, "student_t": student_t, "uber": uber,
}


def lgamma(x: Column) -> Column:
    """log Gamma for x > 0: Stirling's series after a shift to x + 8, exact to about 1e-12."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    shift = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def log_t_density(x: Column, df: float) -> Column:
    """Log density of Student's t."""
    c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return F.lit(c) - (df + 1) / 2 * F.log(1 + x * x / df)


def in_intervals(x: Column, bounds: list[float]) -> Column:
    """F8: whether x lies in one of the closed intervals [b0, b1], [b2, b3], ...; an odd or short list is an error."""
    if len(bounds) < 2 or len(bounds) % 2:
        raise ValueError("intervals need an even number of bounds, two at least")
    out = F.lit(False)
    for a, b in zip(bounds[::2], bounds[1::2]):
        out = out | x.between(a, b)
    return out

"""Vector arithmetic as column expressions: metrics, norms, profiles.  All arithmetic is in double."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, functions as F

COSINE, DOT_PRODUCT, EUCLIDEAN = "COSINE", "DOT_PRODUCT", "EUCLIDEAN"
_ALIASES = {"COSINE": COSINE, "DOT_PRODUCT": DOT_PRODUCT, "IP": DOT_PRODUCT, "EUCLIDEAN": EUCLIDEAN, "L2": EUCLIDEAN}


def metric_of(name: str | None) -> str:
    """Canonical metric; any unknown name means cosine, with a warning."""
    found = _ALIASES.get((name or COSINE).upper())
    if found is None:
        warnings.warn(f"unknown metric {name!r}: cosine is used", stacklevel=2)
    return found or COSINE


def lower_is_better(metric: str) -> bool:
    return metric == EUCLIDEAN


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products."""
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def euclidean(a: Column, b: Column) -> Column:
    """Distance: lower is better."""
    return F.sqrt(_total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; 0 where a norm is 0.  Norms that are known already save their pass."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def score(metric: str, a: Column, b: Column, norm_b: Column | None = None) -> Column:
    metric = metric_of(metric)
    if metric == DOT_PRODUCT:
        return dot(a, b)
    return euclidean(a, b) if metric == EUCLIDEAN else cosine(a, b, norm_b=norm_b)


def profile(v: Column) -> dict[str, Column]:
    """L2 norm, least, greatest, mean and population variance of a vector's components."""
    d = doubles(v)
    n = F.size(d)
    mean = _total(d) / n
    return {"l2": norm(v), "least": F.array_min(d), "greatest": F.array_max(d), "mean": mean, "variance": F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean}


def sampled(v: Column, most: int = 32) -> Column:
    """At most ``most`` evenly spaced components."""
    n = F.size(v)
    step = F.greatest(F.lit(1), F.ceil(n / F.lit(most)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1, step), lambda i: v[i])


def contributions(a: Column, b: Column) -> Column:
    """Product of the components in each dimension."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)


def display_similarity(metric: str, s: Column) -> Column:
    """A score as 0 to 1: 1/(1+d) of a distance, else the score cut to the range."""
    if metric_of(metric) == EUCLIDEAN:
        return 1 / (1 + F.greatest(F.lit(0.0), s))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def similarity_label(shown: Column) -> Column:
    """Five bands of a displayed similarity."""
    return F.when(shown >= 0.9, "very high").when(shown >= 0.75, "high").when(shown >= 0.6, "medium").when(shown >= 0.4, "low").otherwise("very low")

"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; null for a zero vector."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))), 1)


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def decay(age_seconds: Column, half_life_days: float = 30.0) -> Column:
    """0.5 to the power of the age in half-lives; 0 for an unknown age."""
    return F.coalesce(F.pow(F.lit(0.5), F.abs(age_seconds) / F.lit(half_life_days * 86400)), F.lit(0.0))

"""Vector expressions on ARRAY<DOUBLE> columns; sums run in array order, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-8))
    return F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, m: x / m)  # inside a lambda the norm would be found for each component


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def blend(mean: Column, h: Column, alpha: float) -> Column:
    """alpha of the consensus, the rest of the vector itself."""
    return F.zip_with(mean, h, lambda m, x: F.lit(alpha) * m + F.lit(1 - alpha) * x)

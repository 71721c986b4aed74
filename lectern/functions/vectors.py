"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column | str, b: Column | str, size: Column | None = None) -> Column:
    """1 minus the cosine, within 0 and 2; 0 where a vector is zero. ``size`` is the product of the norms, where it is known."""
    size = norm(a) * norm(b) if size is None else size
    return F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / size)))


def l2_normalise(a: Column | str) -> Column:
    """The vector with length 1; zero vectors stay."""
    n = norm(a)
    return F.when(n == 0, _wide(a)).otherwise(F.transform(_wide(a), lambda x: x / n))

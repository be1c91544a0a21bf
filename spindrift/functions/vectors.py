"""Column functions on arrays of numbers, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 minus the cosine; NaN if either vector is all zero."""
    lengths = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(lengths > 0, F.lit(1.0) - dot(a, b) / lengths).otherwise(F.lit(float("nan")))


def unit(v: Column) -> Column:
    """Scaled to length one; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)

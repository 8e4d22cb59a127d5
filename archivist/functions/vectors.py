"""Column functions on vectors (arrays of numbers), in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if lengths differ or a norm is 0."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def same_dim(a: Column, dim: int | Column) -> Column:
    return F.size(a) == dim


def scaled(v: Column, length: Column) -> Column:
    """v / length; unchanged if the length is 0. The length is a column, so that it isn't computed
    again for every component."""
    return F.when(length > 0, F.transform(as_doubles(v), lambda x: x / length)).otherwise(as_doubles(v))

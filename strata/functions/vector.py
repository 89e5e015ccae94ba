"""Vector helpers on ``array<float|double>`` columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalize(a: Column) -> Column:
    """Unit vector in double; a zero vector maps to NULL (no direction)."""
    n = norm(a)
    # an array of one norm: inside the inner function it is a value, not computed again for every component
    unit = F.element_at(F.transform(F.array(n), lambda m: F.transform(a, lambda x: x.cast("double") / m)), 1)
    return F.when(n > 0, unit)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))

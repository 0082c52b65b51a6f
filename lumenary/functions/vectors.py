"""Column functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclid", "manhattan")


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def unit(a: Column, floor: float = 0.0) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    n = norm(a)
    size = F.greatest(n, F.lit(floor)) if floor else n
    return F.transform(a, lambda x: F.when(size > 0, x / size).otherwise(F.lit(0.0)))


def relevance(a: Column, b: Column, metric: str) -> Column:
    """Cosine, or one over one plus the Euclidean or Manhattan distance; cosine with zero is 0."""
    if metric == "cosine":
        return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    if metric == "euclid":
        return 1 / (1 + F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))
    if metric == "manhattan":
        return 1 / (1 + total(F.zip_with(a, b, lambda x, y: F.abs(x - y))))
    raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")


def rounded(a: Column, digits: int) -> Column:
    return F.transform(a, lambda x: F.round(x, digits))


def mean_vector(c: Column, size: int) -> list[Column]:
    """Aggregates, one for each dimension, of an array column's mean."""
    return [F.avg(c[k]) for k in range(size)]

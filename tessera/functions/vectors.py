"""Vectors as ``ARRAY<DOUBLE>`` columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(values) -> Column:
    return F.aggregate(_c(values), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(total(F.transform(_c(a), lambda x: x * x)))


def normalised(a, eps: float = EPS) -> Column:
    """The vector over its norm, or over ``eps`` where that is larger.

    The divisor is bound as a variable of an outer lambda; written inside the
    inner one it would be evaluated again for each element.
    """
    by = F.array(F.greatest(norm(a), F.lit(eps)))
    return F.element_at(F.transform(by, lambda n: F.transform(_c(a), lambda x: x / n)), 1)


def scaled(a, by) -> Column:
    return F.transform(_c(a), lambda x: x / by)


def minus(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def sqdist(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def cosine(a, b, eps: float = EPS) -> Column:
    """Cosine with each norm at least ``eps``."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def mean(vec: str, dim: int) -> Column:
    """Aggregate: the mean vector.  One average per dimension, so partial
    aggregation sends one row per group and task and nothing is exploded."""
    return F.expr("array(" + ", ".join(f"avg(`{vec}`[{i}])" for i in range(dim)) + ")")


def weighted_sum(vec: str, weight: str, dim: int) -> Column:
    """Aggregate: the sum of vectors times their weights."""
    return F.expr("array(" + ", ".join(f"sum(`{vec}`[{i}] * `{weight}`)" for i in range(dim)) + ")")


def rounded(x, places: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(_c(x), places) + F.lit(0.0)

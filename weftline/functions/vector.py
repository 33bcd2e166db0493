"""Distances between vectors as Column expressions: no Python, all inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; null where a vector or an element is null, or the lengths differ."""
    diff = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.sqrt(_fold(a, b, diff)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; null for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n)

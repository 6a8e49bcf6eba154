"""Arithmetic on ``ARRAY<DOUBLE>`` columns (one vector or one pair per row).

For all-pairs work use ``operators.retrieval``: it multiplies whole blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column) -> Column:
    size = norm(vector) + F.lit(EPSILON)
    return F.transform(as_double(vector), lambda x: x / size)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(EPSILON)) * (norm(b) + F.lit(EPSILON)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def vector_sum(vector: str, dim: int, weight: str = "1.0D") -> Column:
    """Aggregate: (weighted) element-wise sum of a vector column as an array.

    ``dim`` plain ``sum`` aggregates combine on the map side and shuffle one
    row per key; exploding positions would shuffle ``dim`` rows per vector.
    """
    sums = ", ".join(f"sum(cast({vector}[{i}] as double) * {weight})" for i in range(dim))
    return F.expr(f"array({sums})")

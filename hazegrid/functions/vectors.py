"""Similarity of stored embedding vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    """Euclidean length; computed once per row and kept, not once per pair."""
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def cosine(left: Column, right: Column, left_norm: Column, right_norm: Column) -> Column:
    return dot(left, right) / F.nullif(left_norm * right_norm, F.lit(0.0))

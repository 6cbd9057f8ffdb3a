"""Column helpers for dense vectors kept as arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector has no length."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm)


def checked_dims(v: Column, dims: int) -> Column:
    return F.when(F.size(v) == dims, v)


def hybrid_score(similarity: Column, lexical: Column, alpha: float = 0.7) -> Column:
    return F.coalesce(similarity, F.lit(0.0)) * alpha + lexical * (1 - alpha)

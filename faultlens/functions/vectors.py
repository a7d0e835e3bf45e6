"""Vector columns in plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def float32_vector(vector: Column) -> Column:
    return vector.cast("array<float>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, of different length or without direction."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = _total(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(_total(F.transform(a, lambda x: x * x))) * F.sqrt(_total(F.transform(b, lambda x: x * x)))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.when(usable, F.try_divide(dot, norms)).otherwise(F.lit(0.0))

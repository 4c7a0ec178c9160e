"""Vectors of any width as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; an error if the widths differ, null if one is null."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors differ in width")).cast("double"))


def magnitude(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 if one vector is zero."""
    lengths = magnitude(a) * magnitude(b)
    return F.when(lengths == 0, 0.0).otherwise(dot(a, b) / lengths)


def normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    length = magnitude(a)
    return F.when(length == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x / length))


def add_to_mean(mean: Column, n: Column, vector: Column) -> Column:
    """Mean of n + 1 vectors from the mean of n and one more."""
    return F.zip_with(mean, vector, lambda m, v: (m * n + v) / (n + 1))


def from_text(text: Column) -> Column:
    """``[1,2,3]`` as an array; null for null or malformed text."""
    return F.from_json(text, "array<float>")


def to_text(vector: Column) -> Column:
    """An array as ``[1,2,3]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))

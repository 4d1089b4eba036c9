"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import as_col


def doubles(vector) -> Column:
    return as_col(vector).cast("array<double>")


def dot(left, right) -> Column:
    return F.aggregate(F.zip_with(doubles(left), doubles(right), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def norm(vector) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector, dimension: int | None = None) -> Column:
    """L2-normalised vector; NULL for a zero norm or a wrong dimension."""
    length = norm(vector)
    usable = length > 0
    if dimension is not None:
        usable = usable & (F.size(as_col(vector)) == dimension)
    return F.when(usable, F.transform(doubles(vector), lambda x: x / length))


def cosine(left, right) -> Column:
    return dot(left, right) / F.nullif(norm(left) * norm(right), F.lit(0.0))

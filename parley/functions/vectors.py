"""Vectors and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def l2_normalize(vector: Column, eps: float = fixed.NORM_EPS) -> Column:
    """The vector divided by its length, in double precision."""
    vector = vector.cast("array<double>")
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x)
    length = F.greatest(F.sqrt(squares), F.lit(eps))
    # The outer transform names the length, or it would be computed for every element.
    scaled = F.transform(F.array(length), lambda n: F.transform(vector, lambda x: x / n))
    return F.get(scaled, F.lit(0))


def decode_text(data: Column) -> Column:
    """UTF-8 bytes as a string."""
    return F.decode(data, "UTF-8")

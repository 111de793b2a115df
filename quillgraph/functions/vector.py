"""Vector measures as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null if either is a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def index_score(cos: Column) -> Column:
    """Cosine on the scale of a vector index, 0 to 1."""
    return (1 + cos) / 2


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))

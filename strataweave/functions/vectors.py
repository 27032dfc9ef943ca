"""Vector functions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where a vector is null or zero, or lengths differ."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def similarity_to(v: Column, query: list[float]) -> Column:
    """Cosine similarity to a fixed vector, whose norm is taken once."""
    fixed = F.array(*(F.lit(float(x)) for x in query))
    length = sum(x * x for x in query) ** 0.5
    return F.when(F.size(v) == len(query), F.try_divide(dot(v, fixed), norm(v) * F.lit(length)))


def is_zero(v: Column) -> Column:
    return (F.size(v) == 0) | F.forall(doubles(v), lambda x: x == 0)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)

"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for vectors that differ in length, are empty or have no length."""
    whole = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (whole > 0), dot(a, b) / whole).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def json_bytes(a: Column) -> Column:
    """UTF-8 size of a vector written as JSON."""
    return F.octet_length(F.to_json(a))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded as SQL engines in binary arithmetic do, halves away from 0; never minus 0."""
    return F.round(x * 10.0**digits, 0) / 10.0**digits + F.lit(0.0)


def sum_of_vectors(vectors: Column) -> Column:
    """Sum by component of vectors of one length."""
    return F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), F.element_at(vectors, 1), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))

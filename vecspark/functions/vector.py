"""Vector arithmetic as column expressions (double precision, evaluated in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def doubles(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def normalize(a: Column, eps: float = EPS) -> Column:
    return F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(eps)))


def joined(a: Column) -> Column:
    """An array of numbers as text."""
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)

"""Vector arithmetic as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b); NaN, which sorts last, when either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ratio = F.when(norms == 0, F.lit(float("nan"))).otherwise(F.try_divide(dot(a, b), norms))
    return F.lit(1.0) - ratio

"""Vector expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-9


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null if lengths differ or an element is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, norms at least 1e-9."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(FLOOR)) * F.greatest(norm(b), F.lit(FLOOR)))


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine similarity to a fixed vector; an all-zero one has none (null)."""
    size = math.sqrt(sum(x * x for x in query))
    if size == 0:
        return F.lit(None).cast("double")
    q = F.array(*[F.lit(float(x)) for x in query])
    return dot(a, q) / (F.greatest(norm(a), F.lit(FLOOR)) * F.lit(max(size, FLOOR)))

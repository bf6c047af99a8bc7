"""Vector Columns: dot product, norm, unit vector, cosine distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_NORM = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Unit vector; a vector of (nearly) zero length is returned as it is."""
    length = F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x, lambda s: F.sqrt(s))
    return F.when(length > ZERO_NORM, F.transform(a, lambda x: x / length)).otherwise(a)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def unit_cosine_distance(a: Column, b: Column) -> Column:
    """Distance of two unit vectors, clamped and rounded to 6 places."""
    return F.round(1.0 - clamp(dot(a, b), -1.0, 1.0), 6)


def cosine_distance(a: Column, b: Column) -> Column:
    """Distance of two raw vectors; 0 if either has (nearly) zero length."""
    na, nb = norm(a), norm(b)
    return F.when((na < ZERO_NORM) | (nb < ZERO_NORM), F.lit(0.0)).otherwise(1.0 - dot(a, b) / (na * nb))

"""Vector algebra on array columns. A missing or zero vector is unavailable (null), not 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def available(a: Column) -> Column:
    return F.coalesce(F.exists(a, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Null for zero vectors and for vectors of different lengths."""
    return F.when((F.size(a) == F.size(b)) & available(a) & available(b), dot(a, b) / (norm(a) * norm(b)))


def unit(a: Column) -> Column:
    return F.when(available(a), F.transform(a, lambda x: x / norm(a))).otherwise(a)


def quantised(a: Column) -> Column:
    """Signed bytes of a unit vector, 127 for 1."""
    return F.transform(a, lambda x: F.round(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * 127).cast("tinyint"))


def interpolate(a: Column, b: Column, t: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (1 - t) * x + t * y)


def valid(a: Column, d: int) -> Column:
    """Of d finite numbers, not all 0."""
    return F.coalesce((F.size(a) == d) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & available(a), F.lit(False))


def blended(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    """Weighted mean of the similarities that are available."""
    w = F.when(a.isNotNull(), wa).otherwise(0) + F.when(b.isNotNull(), wb).otherwise(0)
    return F.when(w > 0, (F.coalesce(a, F.lit(0.0)) * wa + F.coalesce(b, F.lit(0.0)) * wb) / w)

"""Vector expressions over ARRAY<FLOAT|DOUBLE> columns (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Sum of element products in DOUBLE; NULL when lengths differ."""
    a, b = _c(a), _c(b)
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    s = F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), s)


def norm(a) -> Column:
    a = _c(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity; NULL for zero vectors or mismatched lengths."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_clamped(a, b) -> Column:
    """Cosine clamped to [0, 1]; any failure (zero vector, bad length) gives 0.0.

    The coalesce sits inside the clamp because greatest/least skip NULLs.
    """
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine(a, b), F.lit(0.0))))


def l2_normalize(a) -> Column:
    a = _c(a)
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def reduce_dims(a, dims: int) -> Column:
    """Keep the first ``dims`` values and re-normalise to unit length."""
    return l2_normalize(F.slice(_c(a), 1, dims))

"""Vector scalars over ARRAY<DOUBLE> columns (native higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v) -> Column:
    """Divide by the Euclidean norm; the zero vector stays zero."""
    v = _col(v).cast("array<double>")
    n = l2_norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def cosine(a, b) -> Column:
    """Cosine of two vectors; NULL when either is the zero vector."""
    a, b = _col(a).cast("array<double>"), _col(b).cast("array<double>")
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, dot(a, b) / den)

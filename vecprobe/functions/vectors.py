"""Vector arithmetic on array columns with higher-order
functions, so everything stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(vec) -> Column:
    """V1: parse/cast a vector to array<double>."""
    return _c(vec).cast("array<double>")


def l2_norm(vec) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda acc, x: acc + x * x))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def subtract(a, b) -> Column:
    """V3: element-wise a - b."""
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def scale_to(vec, target=1.0, eps: float = 1e-9) -> Column:
    """V4/V5: v / (||v|| + eps) * target."""
    n = l2_norm(vec)
    t = target if isinstance(target, Column) else F.lit(float(target))
    return F.transform(as_double(vec), lambda x: x / (n + F.lit(eps)) * t)


def unit(vec, eps: float = 1e-9) -> Column:
    return scale_to(vec, 1.0, eps)


def zero_fill(vec, d: int) -> Column:
    """missing vector -> zeros of width d."""
    return F.coalesce(as_double(vec), F.array_repeat(F.lit(0.0), d))

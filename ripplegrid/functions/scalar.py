"""Scalar expressions that the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def polyval(coefs: Sequence[float], x: Column) -> Column:
    """Value of a polynomial, its highest power's coefficient first, by Horner's rule."""
    out = F.lit(0.0)
    for c in coefs:
        out = out * x + F.lit(float(c))
    return out


def guarded(total: Column) -> Column:
    """A sum of squares as denominator: 1 where it is 0."""
    return F.when(total > 0, total).otherwise(F.lit(1.0))


def pearson(a: str, b: str) -> Column:
    """Correlation of two columns; null, not an error, if one is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

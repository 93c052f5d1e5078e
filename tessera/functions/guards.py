"""Guarded arithmetic: divisions whose denominator may vanish."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def or_one(c: Column) -> Column:
    """The value, or 1 where it is (nearly) zero."""
    return F.when(c < TINY, F.lit(1.0)).otherwise(c)


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den, or 0 where the denominator is (nearly) zero or missing."""
    return F.coalesce(num / F.when(den >= TINY, den), F.lit(0.0))


def missing(c: Column) -> Column:
    """Null and NaN both count as missing."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def correlation(x: str, y: str) -> Column:
    """Pearson correlation over a group; 0 where either side does not vary."""
    sx, sy = F.var_pop(x) * F.count(F.lit(1)), F.var_pop(y) * F.count(F.lit(1))
    return ratio_or_zero(F.covar_pop(x, y) * F.count(F.lit(1)), F.sqrt(sx * sy))

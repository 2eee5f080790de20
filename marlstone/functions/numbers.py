"""Guarded arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, factor: float = 1.0) -> Column:
    """factor * numerator / denominator; null where the denominator is not positive (F-08)."""
    return F.when(denominator > 0, factor * numerator / denominator)


def nearest_even(x: Column, digits: int = 0) -> Column:
    """Round half to even (F-07)."""
    return F.bround(x, digits)


def rounded(x: Column, digits: int) -> Column:
    """Round a double half away from zero as SQL's round does: on its binary value times 10^digits, where ``F.round`` goes by its shortest decimal text."""
    return F.round(x * 10.0**digits) / 10.0**digits


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def steady_mean(x: Column) -> Column:
    """Aggregate: the mean of doubles; whole parts are summed and divided apart, exactly below 2^53, so that the order of the rows does not show."""
    whole, n = F.rint(x), F.count(x)
    part = F.sum(F.when(x == whole, 0.0).otherwise(x - whole))
    mean = F.floor(F.sum(whole) / n).cast("double")
    return mean + (F.sum(whole) - mean * n + part) / n


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate; rows without a value take no part."""
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))

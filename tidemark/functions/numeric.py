"""Exact decimal helpers: sums stay decimal, one division, one rounding (half away from zero)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERATOR = T.DecimalType(28, 6)
_DENOMINATOR = T.DecimalType(22, 3)


def rounded(value: Column, dtype: T.DecimalType) -> Column:
    """Round to the scale of ``dtype`` and cast; ANSI mode reports an overflow."""
    return F.round(value, dtype.scale).cast(dtype)


def ratio(numerator: Column, denominator: Column, dtype: T.DecimalType) -> Column:
    """``numerator / denominator`` at the scale of ``dtype``; null where the divisor is zero."""
    safe = F.nullif(denominator.cast(_DENOMINATOR), F.lit(0).cast(_DENOMINATOR))
    return rounded(numerator.cast(_NUMERATOR) / safe, dtype)


def percent(part: Column, whole: Column, dtype: T.DecimalType) -> Column:
    """``100 * part / whole``; null where the whole is zero."""
    return ratio(part.cast(_NUMERATOR) * F.lit(100), whole, dtype)


def month_of(day: Column) -> Column:
    """First day of the month."""
    return F.trunc(day, "month")


def count_true(condition: Column) -> Column:
    """Rows where the condition holds (null counts as false)."""
    return F.count_if(condition)

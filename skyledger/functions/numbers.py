"""Numeric expressions: safe casts, null-as-zero sums, differences, rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed values.
SUMMER_PER_YEAR = 0.217264143
MILES_PER_METRE = 0.000621371
DAYS_PER_YEAR = 365


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column, zeros: Sequence[str] = ("-",)) -> Column:
    """Text to double; marks such as ``-`` are zero, other bad text is null."""
    text = F.trim(_col(c).cast("string"))
    return F.when(text.isin(*zeros), 0.0).otherwise(text.try_cast("double"))


def sum_of(*columns: str | Column) -> Column:
    """Sum across columns with null as zero."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(_col(c).cast("double"), F.lit(0.0))
    return total


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def percent_change(a: str | Column, b: str | Column) -> Column:
    """100 (a - b) / b."""
    return ratio((_col(a) - _col(b)) * 100, b)


def close_to(a: str | Column, b: str | Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Tolerance test scaled by the second value; null on either side is not close."""
    gap = F.abs(_col(a) - _col(b)) <= atol + rtol * F.abs(_col(b))
    return F.coalesce(gap, F.lit(False))


def half_even(c: str | Column, places: int = 0) -> Column:
    return F.bround(_col(c).cast("double"), places)


def summer_from_annual(c: str | Column) -> Column:
    return _col(c) * SUMMER_PER_YEAR


def daily_from_annual(c: str | Column) -> Column:
    return _col(c) / DAYS_PER_YEAR


def miles_from_metres(c: str | Column) -> Column:
    return _col(c) * MILES_PER_METRE

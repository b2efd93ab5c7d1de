"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_rate(part: Column, whole: Column, per: float) -> Column:
    """``part * per / whole`` as double; NULL when the whole is 0 or unknown."""
    return part.cast("double") * F.lit(float(per)) / F.nullif(whole.cast("double"), F.lit(0.0))


def percent_or_zero(part: Column, whole: Column, digits: int | None = None) -> Column:
    """Percentage that is 0 when there is nothing to divide by."""
    value = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * F.lit(100.0)
    if digits is not None:
        value = F.round(value, digits)
    return F.when(whole > 0, value).otherwise(F.lit(0.0))


def to_number(c: Column, fill: float | None = None) -> Column:
    """Double, or NULL (or ``fill``) for text that is not a number."""
    number = c.try_cast("double")
    return number if fill is None else F.coalesce(number, F.lit(float(fill)))

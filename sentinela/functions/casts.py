"""Casts that turn bad input into NULL instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, StringType

INTEGER_TYPES = {"byte", "tinyint", "short", "smallint", "int", "integer", "long", "bigint"}


def lenient_integer(c: Column, source: DataType, target: str) -> Column:
    """Whole part of a number; text such as ``12.7`` or `` 12 `` gives 12, other text NULL."""
    if not isinstance(source, StringType):
        return c.try_cast(target)
    # Most texts are plain whole numbers; only for what such a cast refuses are patterns tried.
    number = F.regexp_like(c, F.lit(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"))
    whole = F.regexp_extract(c, r"^\s*([+-]?\d*)", 1)
    whole = F.when(whole.isin("", "+", "-"), F.lit("0")).otherwise(whole)
    return F.coalesce(c.try_cast(target), F.when(number, whole).try_cast(target))


def comma_decimal(c: Column, source: DataType) -> Column:
    """Double from text; where a decimal comma is used, dots separate thousands."""
    if not isinstance(source, StringType):
        return c.try_cast("double")
    dotted = F.translate(F.translate(c, ".", ""), ",", ".")
    return F.when(F.contains(c, F.lit(",")), dotted).otherwise(c).try_cast("double")


def masked_date(c: Column, source: DataType, mask: str) -> Column:
    return F.try_to_date(c, mask) if isinstance(source, StringType) else c.try_cast("date")


def masked_timestamp(c: Column, source: DataType, mask: str) -> Column:
    return F.try_to_timestamp(c, F.lit(mask)) if isinstance(source, StringType) else c.try_cast("timestamp")


def cast_to(c: Column, source: DataType, target: str, mask: str | None = None, trim: bool = True) -> Column:
    """One declared type, by name; ``mask`` applies to dates and timestamps."""
    name = target.strip().lower()
    if name == "date" and mask:
        return masked_date(c, source, mask)
    if name == "timestamp" and mask:
        return masked_timestamp(c, source, mask)
    if name == "double":
        return comma_decimal(c, source)
    if name in INTEGER_TYPES:
        return lenient_integer(c, source, name)
    if name == "string":
        text = c.cast("string")
        return F.trim(text) if trim else text
    return c.try_cast(name)

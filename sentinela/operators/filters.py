"""Row filters."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from sentinela.functions.text import contains_term

REGEX_PREFIX = "*re"


def filter_value(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Equality, or a regex search when the value starts with ``*re``."""
    if isinstance(value, str) and value.startswith(REGEX_PREFIX):
        return df.filter(F.col(column).rlike(value[len(REGEX_PREFIX):]))
    return df.filter(F.col(column) == F.lit(value))


def filter_dates(df: DataFrame, column: str, start: Any = None, end: Any = None) -> DataFrame:
    """Inclusive range on a date, timestamp or text column.

    Unparsable text drops out as soon as there is a bound. A typed column is compared as it
    is, so the bounds reach the scan.
    """
    is_text = isinstance(df.schema[column].dataType, StringType)
    moment = F.try_to_timestamp(column) if is_text else F.col(column)
    if is_text:
        df = df.withColumn(column, moment)
        moment = F.col(column)
    if start is not None:
        df = df.filter(moment >= F.lit(start))
    if end is not None:
        df = df.filter(moment <= F.lit(end))
    return df


def filter_members(df: DataFrame, **allowed: list) -> DataFrame:
    """Keep rows whose columns all have one of the allowed values; NULL is never one."""
    for column, values in allowed.items():
        df = df.filter(F.col(column).isin(list(values)))
    return df


def search_text(df: DataFrame, column: str, term: str, regex: bool = False) -> DataFrame:
    return df.filter(contains_term(F.col(column), term, regex))


def at_latest(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Rows at the largest value of ``column`` among those satisfying ``where``.

    The maximum is a scalar subquery over one column, so it is pruned to that column and,
    on a partitioned table, to the partitions ``where`` selects.
    """
    scope = df.filter(where) if where is not None else df
    return scope.filter(F.col(column) == scope.select(F.max(column)).scalar())

"""Unions, pivots and unpivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns, matched by name."""
    return reduce(lambda left, right: left.unionByName(right), frames)


def wide_to_long(df: DataFrame, keys: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """One row per key and column; ``columns`` maps each column to its label."""
    labelled = df.select(*keys, *[F.col(c).alias(label) for c, label in columns.items()])
    return labelled.unpivot(keys, list(columns.values()), name, value)


def pivot_sum(df: DataFrame, keys: list[str], column: str, values: dict, figure: str) -> DataFrame:
    """Sum of ``figure`` per listed value of ``column``, 0 where there is none.

    The values are given, so no job is needed to find them; the sums are conditional
    aggregates of one grouping.
    """
    sums = [
        F.coalesce(F.sum(F.when(F.col(column) == F.lit(v), F.col(figure))), F.lit(0)).cast("bigint").alias(label)
        for v, label in values.items()
    ]
    return df.groupBy(*keys).agg(*sums)

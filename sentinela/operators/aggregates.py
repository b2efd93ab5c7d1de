"""Configurable aggregations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from sentinela.functions.dates import bucket_end
from sentinela.functions.numeric import percent_or_zero
from sentinela.staging import stage


def aggregate_column(df: DataFrame, function: str, column: str) -> Column:
    """``sum``, ``mean``/``avg``, ``max`` or ``min``; any other name means ``sum``."""
    if function in ("mean", "avg"):
        return F.avg(column)
    if function == "max":
        return F.max(column)
    if function == "min":
        return F.min(column)
    return F.sum(column)


def kpis(df: DataFrame, metrics: dict[str, dict[str, Any]]) -> DataFrame:
    """All configured figures in one pass, one column per label.

    An absent column gives 0, an unknown operation NULL.
    """
    out = []
    for name, metric in metrics.items():
        label, operation, column = metric.get("label", name), metric.get("operation", "count"), metric.get("column")
        if operation == "count":
            figure = F.count(F.lit(1))
        elif operation not in ("sum", "avg", "max", "min", "unique"):
            figure = F.max(F.lit(None).cast("double"))
        elif column not in df.columns:
            figure = F.coalesce(F.max(F.lit(0)), F.lit(0))
        elif operation == "unique":
            figure = F.count_distinct(column)
        elif operation == "sum":
            figure = F.coalesce(F.sum(column), F.lit(0))
        else:
            figure = aggregate_column(df, operation, column)
        out.append(figure.alias(label))
    return df.agg(*out)


def _with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df


def group_aggregate(df: DataFrame, keys: list[str], function: str = "count", column: str | None = None,
                    sort: bool = True, ascending: bool = False, limit: int | None = None) -> DataFrame:
    """Group, aggregate, order by the figure (keys break ties) and keep the first ``limit``.

    Groups with a NULL key are left out; the figure's column carries the function's name.
    """
    present = _with_keys(df, keys).groupBy(*keys)
    if function == "count":
        result = present.agg(F.count(F.lit(1)).alias("count"))
    else:
        result = present.agg(aggregate_column(df, function, column).alias(function))
    if sort:
        figure = F.col(function).asc_nulls_last() if ascending else F.col(function).desc_nulls_last()
        result = result.orderBy(figure, *keys)
    return result.limit(limit) if limit else result


def time_series(df: DataFrame, date_column: str, freq: str = "D", function: str = "count",
                column: str | None = None) -> DataFrame:
    """Figures per day, week or month, with every period between the first and the last.

    An empty period counts and sums to 0 and has no mean or extreme.
    """
    dated = df.select(F.col(date_column).try_cast("date").alias("_day"), *([column] if column else []))
    dated = dated.filter(F.col("_day").isNotNull()).withColumn(date_column, bucket_end(F.col("_day"), freq))
    figure = F.count(F.lit(1)) if function == "count" else aggregate_column(dated, function, column)
    filled = dated.groupBy(date_column).agg(figure.alias(function))
    if function == "sum":
        filled = filled.withColumn(function, F.coalesce(F.col(function), F.lit(0)))
    return fill_periods(filled, date_column, freq, function, zero=function in ("count", "sum"))


def fill_periods(periods: DataFrame, date_column: str, freq: str, figure: str, zero: bool) -> DataFrame:
    """Insert the missing periods of a frame that has one row per period.

    The calendar is the sequence between the first and the last period, met by a left join.
    """
    step = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH"}[freq]
    start = F.trunc(date_column, "MM") if freq == "M" else F.col(date_column)
    known = stage(periods.select(start.alias("_period"), figure), "periods")
    calendar = known.agg(F.min("_period").alias("low"), F.max("_period").alias("high")).filter("low IS NOT NULL").select(
        F.explode(F.sequence("low", "high", F.expr(step))).alias("_period"))
    label = F.last_day("_period") if freq == "M" else F.col("_period")
    present = known.withColumn("_known", F.lit(True))
    empty = F.lit(0 if zero else None).cast(periods.schema[figure].dataType)
    return calendar.join(present, "_period", "left").select(
        label.alias(date_column), F.when(F.col("_known"), F.col(figure)).otherwise(empty).alias(figure))


def success_rate(df: DataFrame, status: str = "status", success: Any = "SUCCEEDED") -> DataFrame:
    good = F.count_if(F.coalesce(F.col(status) == F.lit(success), F.lit(False)))
    return df.agg(percent_or_zero(good, F.count(F.lit(1))).alias("success_rate"))


def value_counts(df: DataFrame, column: str, limit: int | None = None, name: str = "count") -> DataFrame:
    """Rows per value, most frequent first; NULL is not a value."""
    counted = _with_keys(df, [column]).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    counted = counted.orderBy(F.col(name).desc(), column)
    return counted.limit(limit) if limit else counted


def top_failures(df: DataFrame, group: str | None = None, status: str = "status", success: str = "SUCCEEDED",
                 limit: int = 10) -> DataFrame:
    """Groups with most rows whose status is not ``success``; an unknown status is a failure."""
    failed = df.filter(~F.col(status).eqNullSafe(F.lit(success)))
    if group is None or group not in df.columns:
        return failed.agg(F.count(F.lit(1)).alias("failure_count")).filter("failure_count > 0")
    return value_counts(failed, group, limit, "failure_count")


def top_failed_tests(df: DataFrame, group: str = "column_tested", status: str = "status", limit: int = 10) -> DataFrame:
    """Groups with most rows whose status reads failure or failed, in any case."""
    failed = df.filter(F.lower(F.col(status)).isin("failure", "failed"))
    return value_counts(failed, group, limit, "failure_count")


def percentiles_approx(df: DataFrame, column: str, percentiles: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Mergeable sketch: one small buffer per task, whatever the row count."""
    return df.agg(*[F.percentile_approx(column, p, accuracy).alias(name) for name, p in percentiles.items()])

"""Compare a table with its counterpart from another system."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType,
    TimestampNTZType, TimestampType,
)

from sentinela.config import ColumnSpec, parse_schema
from sentinela.functions.text import strip_invisible
from sentinela.operators.casting import cast_frame

# Texts of a sum that equal an absent one.
ZERO_TEXTS = ("0", "0.0", "0.00")


def _verdict(passed: Column) -> Column:
    return F.when(passed, "success").otherwise("failure")


def compare_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts of both sides in one job."""
    sides = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(F.lit(0), F.lit(1)))
    counted = sides.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("left_count"),
                        F.coalesce(F.sum("r"), F.lit(0)).alias("right_count"))
    return counted.withColumn("status", _verdict(F.col("left_count") == F.col("right_count")))


def normalized(df: DataFrame, schema: list[ColumnSpec] | None = None) -> DataFrame:
    """Trim, drop invisible characters and fill NULL in text columns; columns sorted, then cast."""
    columns = []
    for field in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, StringType):
            c = F.coalesce(strip_invisible(c), F.lit(""))
        columns.append(c.alias(field.name))
    clean = df.select(*columns)
    return cast_frame(clean, sorted(schema, key=lambda s: s.name)) if schema else clean


def differing_rows(left: DataFrame, right: DataFrame, schema: list[ColumnSpec] | None = None) -> DataFrame:
    """Distinct rows with how many more times each side has them.

    Both directions come from one signed count; equal rows are combined before the shuffle.
    """
    a, b = normalized(left, schema), normalized(right, schema)
    signed = a.withColumn("_sign", F.lit(1)).unionByName(b.withColumn("_sign", F.lit(-1)))
    balance = signed.groupBy(*a.columns).agg(F.sum("_sign").alias("_balance")).filter("_balance <> 0")
    return balance.select(
        *a.columns,
        F.greatest(F.col("_balance"), F.lit(0)).alias("only_left"),
        F.greatest(-F.col("_balance"), F.lit(0)).alias("only_right"),
    )


def compare_rows(left: DataFrame, right: DataFrame, schema: list[ColumnSpec] | None = None) -> DataFrame:
    """How many rows only one side has."""
    totals = differing_rows(left, right, schema).agg(
        F.coalesce(F.sum("only_left"), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum("only_right"), F.lit(0)).alias("only_right"),
    )
    return totals.withColumn("status", _verdict((F.col("only_left") == 0) & (F.col("only_right") == 0)))


def _double_sum(c: Column) -> Column:
    """Sum of doubles to two decimals, as text, added up as decimals.

    A sum of doubles depends on the order of its additions, and over millions of rows its cents do. Values that
    no decimal holds (NaN, infinite, 10^26 or more), or a sum that none holds, leave the column to the plain sum.
    """
    number = c.try_cast("decimal(38,12)")
    exact, plain = F.try_sum(number), F.sum(c)
    held = (F.count(number) == F.count(c)) & exact.isNotNull()
    return F.when(held, exact.cast("decimal(38,2)").cast("string")).when(
        plain.isNotNull(), F.format_string("%.2f", plain))


def metric_columns(df: DataFrame) -> dict[str, Column]:
    """Figures by type, as text: row count, extremes of dates and times, sums of numbers."""
    metrics: dict[str, Column] = {"row_count": F.count(F.lit(1)).cast("string")}
    for field in df.schema.fields:
        c, name, kind = F.col(f"`{field.name}`"), field.name, field.dataType
        if isinstance(kind, DateType):
            metrics[f"min_{name}"] = F.min(c).cast("string")
            metrics[f"max_{name}"] = F.max(c).cast("string")
        elif isinstance(kind, (TimestampType, TimestampNTZType)):
            metrics[f"min_{name}"] = F.date_format(F.min(c), "yyyy-MM-dd HH:mm:ss")
            metrics[f"max_{name}"] = F.date_format(F.max(c), "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
            metrics[f"sum_{name}"] = F.sum(c.cast("decimal(38,0)")).cast("string")
        elif isinstance(kind, (FloatType, DoubleType)):
            metrics[f"sum_{name}"] = _double_sum(c.cast("double"))
        elif isinstance(kind, DecimalType):
            metrics[f"sum_{name}"] = F.sum(c).cast("decimal(38,2)").cast("string")
    return metrics


def _long(df: DataFrame, metrics: dict[str, Column], side: str) -> DataFrame:
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias(side)) for m in metrics]
    return df.agg(*[c.alias(m) for m, c in metrics.items()]).select(F.inline(F.array(*pairs)))


def compare_metrics(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same figures of both sides, next to each other; an absent sum equals 0."""
    metrics = metric_columns(left)
    a, b = F.col("left_value"), F.col("right_value")
    absent = (a.isNull() & b.isin(*ZERO_TEXTS)) | (b.isNull() & a.isin(*ZERO_TEXTS))
    return (
        _long(left, metrics, "left_value").join(_long(right, metrics, "right_value"), "metric")
        .withColumn("status", _verdict(a.eqNullSafe(b) | absent))
    )


def compare_tables(pairs: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Metric comparison of several tables, told apart by ``table_name``."""
    compared = [
        compare_metrics(left, right).select(F.lit(name).alias("table_name"), "metric", "left_value", "right_value",
                                            "status")
        for name, left, right in pairs
    ]
    return reduce(DataFrame.unionByName, compared)


# Names under which a suite's configuration asks for comparisons.
COUNT_CHECK = "compare_count_df_with_db"
ROW_CHECK = "compare_df_with_df_db"
METRIC_CHECK = "general_metrics_athena_db"
COMPARISONS = (COUNT_CHECK, ROW_CHECK, METRIC_CHECK)

Counterpart = Callable[[dict[str, Any]], DataFrame]


def comparison_outcomes(df: DataFrame, name: str, params: dict[str, Any], counterpart: Counterpart) -> list[dict[str, Any]]:
    """Outcomes of one configured comparison.

    ``counterpart`` turns the check's parameters into the other system's rows, usually by a
    JDBC query; for metrics it is asked once per table, with ``db_table`` set.
    """
    if name == COUNT_CHECK:
        found = compare_counts(df, counterpart(params)).first()
        label = f"Row count comparison: {found['left_count']} and {found['right_count']}"
        return [_comparison("Dataset", label, abs(found["left_count"] - found["right_count"]))]
    if name == ROW_CHECK:
        found = compare_rows(df, counterpart(params), parse_schema(params["schema"])).first()
        different = found["only_left"] + found["only_right"]
        return [_comparison("Dataset", f"Row comparison: {different} divergent row(s)", different)]
    ours, theirs = (params[key].split(",") for key in ("athena_tables", "db_tables"))
    pairs = [(a, df.sparkSession.table(a), counterpart({**params, "db_table": b}))
             for a, b in zip(ours, theirs, strict=True)]
    return [
        _comparison(f"{row['table_name']}.{row['metric']}", f"{row['left_value']} and {row['right_value']}",
                    int(row["status"] == "failure"))
        for row in compare_tables(pairs).collect()
    ]


def _comparison(subject: str, label: str, different: int) -> dict[str, Any]:
    return {"column_tested": subject, "test_applied": label, "unexpected_count": different,
            "mean_unexpected": None, "status": "failure" if different else "success"}

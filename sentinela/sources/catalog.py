"""Catalog tables and stored SQL models."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def table_schema(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and type names, in order."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def run_sql_model(spark: SparkSession, sql: str | None, params: dict[str, Any] | None = None,
                  **frames: DataFrame) -> DataFrame:
    """Run a stored SQL text with ``:name`` parameters; ``{name}`` stands for a given frame.

    Empty text is an error.
    """
    if not sql or not sql.strip():
        raise ValueError("the SQL model is empty")
    return spark.sql(sql, args=params or {}, **frames)

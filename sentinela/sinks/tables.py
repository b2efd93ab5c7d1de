"""Catalog tables: append, overwrite, upsert."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from sentinela.sinks import pending
from sentinela.staging import stage

OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"
SQL_WRITES = ("iceberg", "merge")


@contextmanager
def partition_overwrite(spark: SparkSession, how: str) -> Iterator[None]:
    """Set the overwrite scope for one write; ``insertInto`` has no option of its own for it."""
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, how)
    try:
        yield
    finally:
        spark.conf.set(OVERWRITE_MODE, before)


def in_table_order(df: DataFrame, table: str) -> DataFrame:
    """``insertInto`` is positional, so put the columns in the table's order first."""
    return df.select(*df.sparkSession.table(table).columns)


def rebalanced(df: DataFrame, table: str) -> DataFrame:
    """Gather the rows of each table partition, so that no task writes a file into all of them.

    The rebalance hint lets Spark split a partition that holds much of the data over several
    tasks and put small ones together.
    """
    keys = partition_columns(df.sparkSession, table)
    return df.hint("rebalance", *keys) if keys else df


def _observed(df: DataFrame, counted: Observation | None) -> DataFrame:
    return df if counted is None else df.observe(counted, F.count(F.lit(1)).alias("rows"))


def insert_into(df: DataFrame, table: str, mode: str = "append", partitions: str = "dynamic",
                merge_sql: str | None = None, counted: Observation | None = None) -> None:
    """Append, overwrite, or let a given SQL statement write the rows (seen as ``source_table``).

    With ``partitions="dynamic"`` an overwrite replaces only the partitions it has rows for;
    ``"static"`` replaces the table. ``counted`` observes the written ``rows``, after any shuffle of
    the write, so that map tasks that run again are not counted twice. An upsert that was cut short
    is finished first.
    """
    spark = df.sparkSession
    recover_upserts(spark, table)
    _insert(df, table, mode, partitions, merge_sql, counted)


def _insert(df: DataFrame, table: str, mode: str, partitions: str = "dynamic", merge_sql: str | None = None,
            counted: Observation | None = None) -> None:
    spark = df.sparkSession
    ordered = in_table_order(df, table)
    if mode in SQL_WRITES:
        if not merge_sql:
            raise ValueError(f"mode {mode!r} needs the SQL statement that writes")
        _observed(ordered, counted).createOrReplaceTempView("source_table")
        spark.sql(merge_sql)
    elif mode == "append":
        _observed(rebalanced(ordered, table), counted).write.mode("append").insertInto(table)
    elif mode == "overwrite":
        with partition_overwrite(spark, partitions):
            _observed(rebalanced(ordered, table), counted).write.mode("overwrite").insertInto(table)
    else:
        raise ValueError(f"unsupported write mode {mode!r}")


def upserted(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows without a counterpart in the source, plus all source rows."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def upsert_into(source: DataFrame, table: str, keys: list[str], counted: Observation | None = None) -> None:
    """Upsert for tables whose format has no MERGE; as with MERGE, a key may occur once in the source.

    A key with a NULL in it matches nothing, so its rows are added, whatever their number. Only partitions
    that hold a replaced row or receive a new one are rewritten; one that ends up empty, because its
    rows moved, is dropped.

    The new rows of those partitions, and which of them end up empty, are complete in a write-ahead folder
    before its manifest commits the change in one step; then the table is changed from there. After
    a crash on the way ``recover_upserts``, which every later write calls, brings the table to the state
    before, where the manifest is missing, or to the one after. A table has one writer at a time.
    """
    spark = source.sparkSession
    recover_upserts(spark, table)
    rows = stage(_observed(in_table_order(source, table), counted), "upsert-source")
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    twice = rows.filter(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
    if twice is not None:
        raise ValueError(f"several source rows for {table} have the key {[twice[k] for k in keys]}")
    target, by = spark.table(table), partition_columns(spark, table)
    emptied: list[dict[str, str | None]] = []
    folder = pending.new(spark, table)
    if by:
        replaced = target.join(rows.select(*keys), keys, "left_semi").select(*by)
        # As many as the table has partitions, at most; known values let the scan leave out all others.
        touched = spark.createDataFrame(replaced.union(rows.select(*by)).distinct().collect(), rows.select(*by).schema)
        target = target.join(touched, _same(target, touched, by), "left_semi")
    upserted(target, rows, keys).write.parquet(f"{folder}/rows")
    if by:
        left = _rows_of(spark, table, folder).select(*by).distinct()
        gone = touched.join(left, _same(touched, left, by), "left_anti")
        emptied = [r.asDict() for r in gone.select([F.col(c).cast("string").alias(c) for c in by]).collect()]
    pending.commit(spark, folder, {"partitioned": bool(by), "emptied": emptied})
    recover_upserts(spark, table)


def recover_upserts(spark: SparkSession, table: str) -> int:
    """Finish the committed upserts of a table and forget those that were not; returns how many were finished."""
    done = 0
    for folder, manifest in pending.folders(spark, table):
        if manifest is not None:
            rows = _rows_of(spark, table, folder)
            _insert(rows, table, "overwrite", "dynamic" if manifest["partitioned"] else "static")
            for values in manifest["emptied"]:
                drop_partition(spark, table, values)
            done += 1
        pending.delete(spark, folder)
    return done


def _rows_of(spark: SparkSession, table: str, folder: str) -> DataFrame:
    return spark.read.schema(spark.table(table).schema).parquet(f"{folder}/rows")


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def drop_partition(spark: SparkSession, table: str, values: dict[str, Any]) -> None:
    """Take one partition out of the catalog, and its files too, which an external table would keep."""
    quoted = {c: "null" if v is None else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" for c, v in values.items()}
    spec = ", ".join(f"`{c}` = {v}" for c, v in quoted.items())
    if spark.sql(f"SHOW PARTITIONS {table} PARTITION ({spec})").first() is None:
        return
    # Files first: a partition without files has no rows, files without a partition could be found again.
    location = spark.sql(f"DESCRIBE FORMATTED {table} PARTITION ({spec})").filter("col_name = 'Location'").first()[1]
    pending.delete(spark, location)
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({spec})")
    spark.catalog.refreshTable(table)

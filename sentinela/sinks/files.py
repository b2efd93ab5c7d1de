"""Files: CSV, Parquet and JSON landings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Observation, functions as F

from sentinela.config import split_identifier


# Records of a landed file: compressed, it is one task's work to read.
RECORDS_PER_FILE = 50_000


def dated_path(root: str, identifier: str, day: date) -> str:
    """``<root>/<source>/<table>/<yyyymmdd>``"""
    table, source = split_identifier(identifier)
    return f"{root.rstrip('/')}/{source}/{table}/{day:%Y%m%d}"


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", compression: str = "gzip") -> int:
    """Write CSV and return the number of rows, counted while writing."""
    observed, counted = _counted(df)
    observed.write.options(header=header, sep=sep, compression=compression).csv(path)
    return counted.get["rows"]


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    observed, counted = _counted(df)
    if partition_by:
        observed = observed.hint("rebalance", *partition_by)
    observed.write.partitionBy(*(partition_by or [])).parquet(path)
    return counted.get["rows"]


def land_json(df: DataFrame, root: str, ingestion_date: str, compression: str = "gzip",
              records_per_file: int = RECORDS_PER_FILE) -> str:
    """Land records as JSON under their ingestion date; returns the folder.

    Field names in every record make plain JSON many times larger than what it holds, hence compressed. A
    compressed file cannot be split, so none has more than ``records_per_file`` records.
    """
    path = f"{root.rstrip('/')}/ingestion_date={ingestion_date}"
    df.write.options(ignoreNullFields="false", compression=compression, maxRecordsPerFile=records_per_file).json(path)
    return path


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    counted = Observation()
    return df.observe(counted, F.count(F.lit(1)).alias("rows")), counted

"""Writes to relational databases."""

from __future__ import annotations

from pyspark.sql import DataFrame

BATCH_ROWS = 10_000


def jdbc_write_options(url: str, table: str, user: str, password: str, mode: str,
                       driver: str | None = None, batch_rows: int = BATCH_ROWS) -> dict[str, str]:
    """An overwrite empties the table and keeps its definition, grants and indexes."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unsupported write mode {mode!r}")
    options = {"url": url, "dbtable": table, "user": user, "password": password, "batchsize": str(batch_rows)}
    if mode == "overwrite":
        options["truncate"] = "true"
    if driver:
        options["driver"] = driver
    return options


def write_jdbc(df: DataFrame, options: dict[str, str], mode: str = "append", connections: int | None = None) -> None:
    """``connections`` bounds how many tasks write at once; without it every partition opens one."""
    if connections:
        options = {**options, "numPartitions": str(connections)}
    df.write.format("jdbc").options(**options).mode(mode).save()

"""Run records of the jobs and of their quality suites."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sentinela.config import split_identifier

LOG_COLUMNS = {
    "execution_id": "string", "start_execution": "timestamp_ntz", "end_execution": "timestamp_ntz",
    "source": "string", "table_name": "string", "job_name": "string", "layer": "string", "status": "string",
    "error": "string", "error_description": "string", "warning_description": "string", "has_bdq": "boolean",
    "critical_table": "boolean", "file_name": "string", "count": "bigint", "info": "map<string,string>",
    "quality_tests": "array<struct<column_tested:string,test_applied:string,status:string>>", "dt_ref": "date",
}
LOG_SCHEMA = ", ".join(f"`{name}` {kind}" for name, kind in LOG_COLUMNS.items())
LOCAL_OFFSET = timedelta(hours=3)


def local_now() -> datetime:
    """Current time at the fixed UTC-3 offset of the records."""
    return datetime.now(timezone.utc).replace(tzinfo=None) - LOCAL_OFFSET


def execution_id(job: Column, target: Column, started: Column) -> Column:
    """Id of the runs in a table; the rule of ``RunLog`` for whole seconds."""
    return F.sha2(F.concat_ws("-", job, target, F.date_format(started, "yyyy-MM-dd HH:mm:ss")), 256)


class RunLog:
    """One run: collects facts while the job works and is written once, as one typed row."""

    def __init__(self, spark: SparkSession, root: str, job_name: str, target: str, layer: str,
                 critical: bool = False, clock=local_now) -> None:
        self._spark, self._root, self._clock = spark, root, clock
        started = clock()
        self._checkpoint = started
        try:
            table, source = split_identifier(target)
        except ValueError:
            table, source = target, None
        seed = f"{job_name}-{target}-{started}"
        self.record: dict[str, Any] = {
            "execution_id": hashlib.sha256(seed.encode()).hexdigest(),
            "start_execution": started, "end_execution": started, "source": source, "table_name": table,
            "job_name": job_name, "layer": layer, "status": "success", "error": None,
            "error_description": None, "warning_description": None, "has_bdq": False,
            "critical_table": critical, "file_name": None, "count": None, "info": {},
            "quality_tests": [], "dt_ref": started.date(),
        }

    def add(self, **facts: Any) -> None:
        """Known fields are set; anything else goes to ``info`` as text."""
        for name, value in facts.items():
            if name in self.record and name != "info":
                self.record[name] = value
            else:
                self.record["info"][name] = None if value is None else str(value)

    def step(self, name: str) -> None:
        """Store the seconds since the previous step."""
        now = self._clock()
        self.record["info"][name] = str(round((now - self._checkpoint).total_seconds(), 2))
        self._checkpoint = now

    def warning(self, message: str) -> None:
        self.record["status"] = "warning"
        self.record["warning_description"] = message

    def error(self, message: str, description: str | None = None) -> None:
        """Record a failure and write at once, since the job is about to stop."""
        self.record.update(status="error", error=message, error_description=description)
        self.write()

    def frame(self) -> DataFrame:
        values = tuple(self.record[name] for name in LOG_COLUMNS)
        return self._spark.createDataFrame([values], LOG_SCHEMA)

    def write(self) -> None:
        self.record["end_execution"] = self._clock()
        self.frame().coalesce(1).write.mode("append").partitionBy("dt_ref").parquet(self._root)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(root)


def refresh_partitions(spark: SparkSession, table: str) -> None:
    """Make partitions written by path visible to a catalog table."""
    spark.catalog.recoverPartitions(table)

"""Shared scratch space: staged tables cut lineage and give the optimizer real sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
# What the open scopes staged, the innermost last.
_SCOPES: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting falls back to a folder of its own; a cluster without it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="sentinela-")
    return _LOCAL_ROOT[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused between runs."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/sentinela/{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    For a result that several branches of one plan need: the heavy part runs once, a lost
    executor costs no recomputation, later branches read only their columns, and the file
    sizes let Spark decide by itself whether a side is small enough to broadcast.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    for scope in _SCOPES[-1:]:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was staged inside; nothing that is still to be read may come from there."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            _delete(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this application staged; call it when no staged frame is needed any more."""
    folder = f"{scratch_root(spark)}/sentinela/{spark.sparkContext.applicationId}"
    _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

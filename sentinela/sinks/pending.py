"""Write-ahead folders: what a change of a table needs is complete and committed before the table is touched.

A change is a folder with its rows and, last of all, a manifest that one rename puts in place. Until
then the change has not happened; from then on it can be applied again and again until its folder is
gone. Folders lie beside the table (``_pending/<table folder>/<id>``), in the same store.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

MANIFEST = "manifest.json"


def _store(spark: SparkSession, path: str):
    """The path and its store, as Spark itself reaches it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def location(spark: SparkSession, table: str) -> str:
    return spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").first()[1].rstrip("/")


def root(spark: SparkSession, table: str) -> str:
    parent, _, name = location(spark, table).rpartition("/")
    return f"{parent}/_pending/{name}"


def new(spark: SparkSession, table: str) -> str:
    """A folder for one change; nothing is in force before ``commit``."""
    return f"{root(spark, table)}/{uuid.uuid4().hex}"


def commit(spark: SparkSession, folder: str, manifest: dict[str, Any]) -> None:
    """Put the manifest in place, in one step."""
    written, store = _store(spark, f"{folder}/_{MANIFEST}")
    out = store.create(written, True)
    try:
        out.write(bytearray(json.dumps(manifest), "utf-8"))
    finally:
        out.close()
    if not store.rename(written, _store(spark, f"{folder}/{MANIFEST}")[0]):
        raise OSError(f"cannot commit {folder}")


def folders(spark: SparkSession, table: str) -> list[tuple[str, dict[str, Any] | None]]:
    """Changes that are not done with, the oldest first, and their manifests; None where there is no manifest."""
    top, store = _store(spark, root(spark, table))
    if not store.exists(top):
        return []
    found = []
    for status in sorted(store.listStatus(top), key=lambda s: s.getModificationTime()):
        folder = status.getPath().toString()
        path, _ = _store(spark, f"{folder}/{MANIFEST}")
        manifest = None
        if store.exists(path):
            stream = store.open(path)
            try:
                manifest = json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
            finally:
                stream.close()
        found.append((folder, manifest))
    return found


def delete(spark: SparkSession, folder: str) -> None:
    path, store = _store(spark, folder)
    store.delete(path, True)

"""The two configuration-driven jobs: bronze to silver, silver to gold."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sentinela.config import IngestSpec, QualitySpec, RefineSpec
from sentinela.operators.casting import cast_frame
from sentinela.operators.filters import filter_value
from sentinela.operators.quality import run_suite
from sentinela.operators.reconcile import Counterpart
from sentinela.sinks.runlog import RunLog
from sentinela.sinks.tables import SQL_WRITES, insert_into, upsert_into
from sentinela.sources.catalog import run_sql_model
from sentinela.sources.delimited import read_delimited, read_without_edges
from sentinela.sources.json import read_json
from sentinela.sources.lines import (
    add_date_from_line, add_literal_date, cut_fixed_width, drop_edge_lines, positioned_lines, read_lines,
)
from sentinela.sources.partitions import ingestion_path
from sentinela.staging import scratch_scope, stage

EXTENSIONS = ("csv", "txt", "json")


def read_bronze(spark: SparkSession, spec: IngestSpec, path: str, variables: dict[str, str] | None = None) -> DataFrame:
    """Read, cut, align and add literal columns, as the table's extension asks; still untyped."""
    options = dict(spec.options)
    literal = spec.literal.resolve(variables or {}) if spec.literal else None
    names = [c.source for c in spec.columns]
    from_line = literal is not None and literal.line is not None
    if from_line and spec.ext == "json":
        raise ValueError("a date cannot be cut from a line of a JSON document")
    by_line = spec.ext != "json" and (spec.skip_header or spec.skip_footer or from_line)
    placed = positioned_lines(spark, path, spec.encoding) if by_line else None
    if spec.ext == "json":
        df = read_json(spark, path, spec.explode_column, _json_schema(spec), encoding=spec.encoding, **options)
    elif spec.ext == "txt":
        lines = read_lines(spark, path, spec.encoding)
        if by_line:
            lines = drop_edge_lines(placed, int(spec.skip_header), spec.skip_footer)
        df = cut_fixed_width(lines, list(spec.layout), spec.positional) if spec.layout else lines
    elif spec.ext == "csv":
        align = str(options.pop("normalize_schema", False)).lower() == "true"
        if by_line:
            df = read_without_edges(placed, names, spec.header, spec.sep, spec.skip_header, spec.skip_footer, spec.encoding,
                                    **options)
        else:
            df = read_delimited(spark, path, names, spec.header, spec.sep, spec.encoding, align, **options)
    else:
        raise ValueError(f"unsupported extension {spec.ext!r}; supported are {EXTENSIONS}")
    if from_line:
        df = add_date_from_line(df, placed, literal, spec.encoding)
    elif literal is not None:
        df = add_literal_date(df, literal)
    return df.drop("_file", "_block", "_length", "_size")


def _json_schema(spec: IngestSpec) -> StructType:
    """Declared fields as text, as in the other formats: no inference pass, no types that depend on the data.

    Documents of one line each (``multiline`` false) let Spark split large files.
    """
    fields = StructType([StructField(c.source, StringType()) for c in spec.columns])
    return StructType([StructField(spec.explode_column, ArrayType(fields))]) if spec.explode_column else fields


def bronze_to_silver(
    spark: SparkSession,
    spec: IngestSpec,
    dt_ref: str,
    file_name: str | None = None,
    quality: QualitySpec | None = None,
    log: RunLog | None = None,
    partitions: str = "dynamic",
    counterpart: Counterpart | None = None,
) -> dict[str, Any]:
    """Read one ingestion date, cast, filter, check and write; returns count and test outcomes.

    Without checks, rows are counted while they are written. With checks, the cast rows are
    staged once, so that checking and writing do not read and cast the input again;
    ``counterpart`` supplies the other system's rows to checks that compare with it. Staged copies
    are deleted at the end.
    """
    with scratch_scope(spark):
        return _ingest(spark, spec, dt_ref, file_name, quality, log, partitions, counterpart)


def _ingest(spark: SparkSession, spec: IngestSpec, dt_ref: str, file_name: str | None, quality: QualitySpec | None,
            log: RunLog | None, partitions: str, counterpart: Counterpart | None) -> dict[str, Any]:
    try:
        path = ingestion_path(spec.bronze_path, dt_ref, file_name)
        raw = read_bronze(spark, spec, path, {"dt_ref": dt_ref})
        extra = [spec.literal.name] if spec.literal else []
        df = cast_frame(raw, spec.columns, spec.positional, spec.partition_column, extra)
        if spec.filter_column and spec.filter_value:
            df = filter_value(df, spec.filter_column, spec.filter_value)
        if log:
            log.add(file_name=file_name or "none", critical_table=spec.critical)
            log.step("read_and_cast")

        outcomes: list[dict[str, Any]] = []
        if spec.has_quality:
            if quality is None:
                raise ValueError(f"quality checks are on for {spec.target!r} but none are configured")
            df = stage(df, f"silver-{spec.target}")
            outcomes = _check(df, quality, log, counterpart)

        counted = Observation()
        _write(df, spec, partitions, counted)
        rows = counted.get["rows"]
        if log:
            if rows == 0:
                log.add(warning=f"no rows in {path}")
            log.add(count=rows)
            log.step("insert_table")
            log.write()
        return {"rows": rows, "quality": outcomes}
    except Exception as failure:
        if log and log.record["status"] != "error":
            log.error(f"bronze to silver failed for {spec.target}", str(failure))
        raise


def _check(df: DataFrame, quality: QualitySpec, log: RunLog | None,
           counterpart: Counterpart | None) -> list[dict[str, Any]]:
    try:
        outcomes = run_suite(df, quality, counterpart)
    except Exception as failure:
        if log and hasattr(failure, "outcomes"):
            log.add(has_bdq=True, quality_tests=_log_tests(failure.outcomes))
        raise
    if log:
        log.add(has_bdq=True, quality_tests=_log_tests(outcomes))
        if any(o["status"] == "failure" for o in outcomes):
            log.warning("One or more quality checks failed.")
        log.step("quality")
    return outcomes


def _log_tests(outcomes: list[dict[str, Any]]) -> list[dict[str, str]]:
    return [{k: o[k] for k in ("column_tested", "test_applied", "status")} for o in outcomes]


def _write(df: DataFrame, spec: IngestSpec, partitions: str, counted: Observation) -> None:
    if spec.mode in SQL_WRITES and not spec.merge_sql:
        upsert_into(df, spec.silver_table, list(spec.merge_keys), counted)
    else:
        insert_into(df, spec.silver_table, spec.mode, partitions, spec.merge_sql, counted)


def silver_to_gold(
    spark: SparkSession,
    spec: RefineSpec,
    model: str | Callable[[], DataFrame],
    params: dict[str, Any] | None = None,
    frames: dict[str, DataFrame] | None = None,
    log: RunLog | None = None,
) -> int:
    """Run a gold model (SQL text or a function) and replace the partitions it has rows for.

    A model whose mode leaves the write to its own SQL is only run. Returns the row count; copies
    that the model staged are deleted.
    """
    with scratch_scope(spark):
        return _refine(spark, spec, model, params, frames, log)


def _refine(spark: SparkSession, spec: RefineSpec, model: str | Callable[[], DataFrame], params: dict[str, Any] | None,
            frames: dict[str, DataFrame] | None, log: RunLog | None) -> int:
    try:
        if callable(model):
            df = model()
        else:
            df = run_sql_model(spark, model, params, **(frames or {}))
        rows = 0
        if spec.mode not in SQL_WRITES:
            counted = Observation()
            insert_into(df, spec.table, spec.mode, counted=counted)
            rows = counted.get["rows"]
        if log:
            log.add(mode=spec.mode, refined_layer=spec.layer, target=spec.table, count=rows)
            log.step("table_insert")
            log.write()
        return rows
    except Exception as failure:
        if log and log.record["status"] != "error":
            log.error(f"silver to gold failed for {spec.target}", str(failure))
        raise

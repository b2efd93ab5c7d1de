"""Declarative parameters: plain dictionaries or JSON, never evaluated as code."""

from __future__ import annotations

import ast
import json
from dataclasses import dataclass, field
from typing import Any


def parse_value(value: Any) -> Any:
    """Native value of a parameter that may arrive as text; text that is no literal stays text."""
    if not isinstance(value, str) or not value.strip():
        return value
    text = value.strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for parse in (json.loads, ast.literal_eval):
        try:
            return parse(text)
        except (ValueError, SyntaxError):
            continue
    return value


def split_identifier(identifier: str) -> tuple[str, str]:
    """``source_table_name`` -> (``table_name``, ``source``), split at the first underscore."""
    source, separator, table = identifier.partition("_")
    if not separator or not source or not table:
        raise ValueError(f"{identifier!r} is not <source>_<table>")
    return table, source


@dataclass(frozen=True)
class ColumnSpec:
    """Target column: type name, optional mask, and the source column it is read from."""

    name: str
    type: str
    source: str
    mask: str | None = None

    @classmethod
    def parse(cls, name: str, declared: Any) -> ColumnSpec:
        """``type``, ``[type, mask]`` or ``[source, type, mask]``."""
        if isinstance(declared, str):
            return cls(name.lower(), declared, name)
        parts = list(declared)
        if len(parts) == 2:
            return cls(name.lower(), parts[0], name, parts[1])
        if len(parts) == 3:
            return cls(name.lower(), parts[1], parts[0], parts[2])
        raise ValueError(f"column {name!r}: expected a type, [type, mask] or [source, type, mask]")


def parse_schema(schema: Any) -> list[ColumnSpec]:
    declared = parse_value(schema)
    if not isinstance(declared, dict) or not declared:
        raise ValueError("a table schema is a non-empty mapping of column to type")
    return [ColumnSpec.parse(name, spec) for name, spec in declared.items()]


@dataclass(frozen=True)
class LiteralColumn:
    """Date column added to every row: a constant, a slice of a header line, or the run date."""

    name: str
    mask: str
    value: str | None = None
    line: int | None = None
    start: int | None = None
    end: int | None = None
    variable: str | None = None

    @classmethod
    def parse(cls, params: Any) -> LiteralColumn | None:
        """``value`` is a date text, ``row,<line>,<start>:<end>``, or a run variable's name."""
        params = parse_value(params)
        if not params:
            return None
        name, mask, value = params["column_name"], params["mask"], str(params["value"])
        if value.startswith("row,"):
            _, line, span = value.split(",")
            start, end = span.split(":")
            return cls(name, mask, line=int(line), start=int(start), end=int(end))
        if str(params.get("dt_type", "date")).lower() != "date":
            raise ValueError("a literal column is a date")
        if params.get("variable"):
            return cls(name, mask, variable=value)
        return cls(name, mask, value=value)

    def resolve(self, variables: dict[str, str]) -> LiteralColumn:
        """Replace a run variable by its value; an unknown one is an error."""
        if self.variable is None:
            return self
        if self.variable not in variables:
            raise KeyError(f"literal column {self.name!r}: no run variable {self.variable!r}")
        return LiteralColumn(self.name, self.mask, value=variables[self.variable])


@dataclass(frozen=True)
class IngestSpec:
    """Everything the bronze-to-silver job needs to know about one table."""

    target: str
    ext: str
    bronze_path: str
    silver_table: str
    columns: list[ColumnSpec]
    header: bool = True
    sep: str | None = None
    encoding: str = "UTF-8"
    options: dict[str, Any] = field(default_factory=dict)
    explode_column: str | None = None
    skip_header: bool = False
    skip_footer: bool = False
    filter_column: str | None = None
    filter_value: str | None = None
    positional: tuple[str, ...] = ()
    layout: tuple[tuple[str, int, int], ...] = ()
    literal: LiteralColumn | None = None
    partition_column: str | None = None
    mode: str = "overwrite"
    merge_sql: str | None = None
    merge_keys: tuple[str, ...] = ()
    has_quality: bool = False
    critical: bool = False

    @classmethod
    def parse(cls, params: dict[str, Any]) -> IngestSpec:
        # Names that existing configuration records use for the same settings.
        params = {**params, "bronze_path": params.get("bronze_path") or params.get("s3_bronze_path"),
                  "merge_query": params.get("merge_query") or params.get("iceberg_query")}
        required = ("trgt_tbl", "ext", "bronze_path", "silver_table", "table_schema")
        missing = [name for name in required if not params.get(name)]
        if missing:
            raise ValueError(f"missing ingestion parameters: {missing}")
        get = lambda key, default=None: parse_value(params.get(key, default))
        return cls(
            target=params["trgt_tbl"],
            ext=str(params["ext"]).lower(),
            bronze_path=params["bronze_path"],
            silver_table=params["silver_table"],
            columns=parse_schema(params["table_schema"]),
            header=bool(get("header", True)),
            sep=params.get("sep"),
            encoding=params.get("encoding", "UTF-8"),
            options=dict(get("options_params", {}) or {}),
            explode_column=params.get("explode_column"),
            skip_header=bool(get("skip_header", False)),
            skip_footer=bool(get("skip_footer", False)),
            filter_column=params.get("filter_column"),
            filter_value=params.get("filter_value"),
            positional=tuple(get("positional_column", ()) or ()),
            layout=tuple((str(n), int(s), int(e)) for n, s, e in (get("layout", ()) or ())),
            literal=LiteralColumn.parse(params.get("lit_values")),
            partition_column=params.get("partition_column"),
            mode=params.get("mode", "overwrite"),
            merge_sql=params.get("merge_query"),
            merge_keys=tuple(get("merge_keys", ()) or ()),
            has_quality=bool(get("has_bdq", False)),
            critical=bool(get("critical", False)),
        )


@dataclass(frozen=True)
class RefineSpec:
    """Target, layer and write mode of one gold model."""

    target: str
    layer: str = "gold"
    mode: str = "overwrite"
    partition_column: str | None = None

    @classmethod
    def parse(cls, params: dict[str, Any]) -> RefineSpec:
        if not params.get("target_table"):
            raise ValueError("missing refine parameter: target_table")
        spec = cls(params["target_table"], params.get("layer", "gold"), params.get("mode", "overwrite"),
                   params.get("partition_column"))
        if spec.layer != "gold":
            raise ValueError(f"layer {spec.layer!r} is not supported, only gold is")
        return spec

    @property
    def table(self) -> str:
        return f"{self.layer}.{split_identifier(self.target)[0]}"


@dataclass(frozen=True)
class QualitySpec:
    """Checks of one table, and whether a failure keeps it from being written."""

    target: str
    checks: dict[str, Any]
    stop_job: bool = False

    @classmethod
    def parse(cls, params: dict[str, Any]) -> QualitySpec:
        checks = parse_value(params.get("quality_params"))
        if not checks:
            raise ValueError(f"no quality checks configured for {params.get('trgt_tbl')!r}")
        checks = dict(checks)
        nested_stop = checks.pop("stop_job", False)
        stop = parse_value(params.get("stop_job", nested_stop))
        return cls(params["trgt_tbl"], checks, bool(stop))

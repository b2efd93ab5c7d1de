import pytest

from sentinela.config import (
    ColumnSpec, IngestSpec, LiteralColumn, QualitySpec, RefineSpec, parse_schema, parse_value, split_identifier,
)


@pytest.mark.parametrize("text, value", [
    ("False", False), ("TRUE", True), ("-7", -7), ("['x', 'y']", ["x", "y"]), ("(1, 'a')", (1, "a")),
    ('{"k": null}', {"k": None}), ("{'k': None}", {"k": None}), ("a b: c", "a b: c"), ("", ""), ("\t", "\t"),
    (None, None), (2.5, 2.5), ({"k": 1}, {"k": 1}), ("open('f')", "open('f')"),
])
def test_parse_value(text, value):
    assert parse_value(text) == value


def test_split_identifier():
    assert split_identifier("censo_domicilios_por_bairro") == ("domicilios_por_bairro", "censo")
    for bad in ("censo", "_bairro", "censo_", ""):
        with pytest.raises(ValueError):
            split_identifier(bad)


def test_names_of_existing_configuration_records():
    spec = IngestSpec.parse({"trgt_tbl": "a_b", "ext": "json", "s3_bronze_path": "s3://x/y", "silver_table": "s.t",
                             "table_schema": {"k": "int"}, "iceberg_query": "MERGE INTO t"})
    assert (spec.bronze_path, spec.merge_sql) == ("s3://x/y", "MERGE INTO t")


def test_column_specs():
    columns = parse_schema("{'A': 'int', 'b': ['date', 'yyyy-MM-dd'], 'c': ['raw', 'timestamp', 'yyyy']}")
    assert columns == [ColumnSpec("a", "int", "A"), ColumnSpec("b", "date", "b", "yyyy-MM-dd"),
                       ColumnSpec("c", "timestamp", "raw", "yyyy")]
    for bad in ("[]", {}, None, {"a": ["x"]}):
        with pytest.raises(ValueError):
            parse_schema(bad)


def test_literal_column():
    assert LiteralColumn.parse(None) is None
    row = LiteralColumn.parse({"column_name": "d", "mask": "yyyyMMdd", "value": "row,0,3:11"})
    assert (row.line, row.start, row.end) == (0, 3, 11)
    variable = LiteralColumn.parse({"column_name": "d", "mask": "yyyy-MM-dd", "value": "dt_ref", "variable": True})
    assert variable.resolve({"dt_ref": "2026-01-01"}).value == "2026-01-01"
    with pytest.raises(KeyError):
        variable.resolve({})
    with pytest.raises(ValueError):
        LiteralColumn.parse({"column_name": "d", "mask": "x", "value": "1", "dt_type": "int"})


def test_ingest_spec_requires_parameters():
    with pytest.raises(ValueError, match="bronze_path"):
        IngestSpec.parse({"trgt_tbl": "a_b", "ext": "csv", "silver_table": "t", "table_schema": "{'a': 'int'}"})


def test_refine_spec():
    spec = RefineSpec.parse({"target_table": "gold_tb_ft_x"})
    assert (spec.table, spec.mode) == ("gold.tb_ft_x", "overwrite")
    with pytest.raises(ValueError):
        RefineSpec.parse({"target_table": "gold_tb_ft_x", "layer": "silver"})


def test_quality_spec_reads_stop_from_either_place():
    assert QualitySpec.parse({"trgt_tbl": "a", "stop_job": "true", "quality_params": {"x": {}}}).stop_job
    nested = QualitySpec.parse({"trgt_tbl": "a", "quality_params": {"x": {}, "stop_job": True}})
    assert nested.stop_job and nested.checks == {"x": {}}
    with pytest.raises(ValueError):
        QualitySpec.parse({"trgt_tbl": "a", "quality_params": {}})

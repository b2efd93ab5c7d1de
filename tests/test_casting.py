from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sentinela.config import parse_schema
from sentinela.functions.dates import bucket_end, epoch_millis_to_date, java_pattern, seconds_between
from sentinela.functions.labels import age_band, alert_name, disease_name, epidemic_flag, rt_status, size_class
from sentinela.functions.text import contains_term, slice_text, strip_invisible, strip_parenthesis_suffix
from sentinela.operators.casting import cast_frame, coerce_numeric
from tests.conftest import rows


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column).first()[0]


def test_declared_types_of_a_text_table(spark):
    """Names differ in case, blanks surround all values, thousands and decimals are marked in both ways."""
    df = spark.createDataFrame(
        [(" vila nova\t", " 7 ", "1.250.000,75"), ("", "08", "-3,5"), (None, "sete", "12")],
        "Bairro string, QTD string, area string")
    out = cast_frame(df, parse_schema({"area": "double", "bairro": "string", "qtd": "int"}))
    assert out.dtypes == [("area", "double"), ("bairro", "string"), ("qtd", "int")]
    assert rows(out, "qtd", "area") == [(None, 12.0), (7, 1250000.75), (8, -3.5)]
    assert {r.bairro for r in out.collect()} == {"vila nova\t", "", None}


def test_a_date_under_another_name(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["29/02/2024", "29/02/2023", "1/1/24", "", None])], "k int, emissao string")
    out = cast_frame(df, parse_schema({"k": "int", "dt_emissao": ["emissao", "date", "dd/MM/yyyy"]}))
    assert {r.k: r.dt_emissao for r in out.collect()} == {0: date(2024, 2, 29), 1: None, 2: None, 3: None, 4: None}


@pytest.mark.parametrize("text, value", [
    ("12.7", 12), (" 12 ", 12), ("abc", None), ("-12.7", -12), ("", None), (None, None), ("1e3", None),
    ("99999999999", None), ("12.9999999", 12), ("-0.99999999", 0), (".5", 0), ("5.", 5), (".", None), ("+3", 3),
])
def test_lenient_integer(spark, text, value):
    df = spark.createDataFrame([(text,)], "x string")
    assert cast_frame(df, parse_schema({"x": "int"})).first()[0] == value


@pytest.mark.parametrize("text, value", [("1.234,5", 1234.5), ("1.5", 1.5), ("1,5", 1.5), ("x", None), ("1.2.3", None)])
def test_comma_decimal(spark, text, value):
    df = spark.createDataFrame([(text,)], "x string")
    assert cast_frame(df, parse_schema({"x": "double"})).first()[0] == value


def test_cast_other_types_and_order(spark):
    df = spark.createDataFrame([("10.239", "2026-02-03 04:05:06", " x ", "true")], "d string, t string, s string, b string")
    out = cast_frame(df, parse_schema({"s": "string", "d": "decimal(10,2)", "b": "boolean",
                                       "t": ["timestamp", "yyyy-MM-dd HH:mm:ss"]}), positional=["s"], partition_column="s")
    assert out.columns == ["d", "b", "t", "s"]
    assert tuple(out.first()) == (Decimal("10.24"), True, datetime(2026, 2, 3, 4, 5, 6), " x ")


def test_cast_typed_input(spark):
    df = spark.sql("SELECT 12.9D AS a, 5L AS b, DATE '2026-01-02' AS c, 3 AS d")
    out = cast_frame(df, parse_schema({"a": "int", "b": "double", "c": ["date", "yyyy-MM-dd"], "d": "string"}))
    assert tuple(out.first()) == (12, 5.0, date(2026, 1, 2), "3")


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="nope"):
        cast_frame(spark.range(1), parse_schema({"nope": "int"}))


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1.5", "a"), (None, "2")], "x string, y string")
    assert rows(coerce_numeric(df, ["x", "y", "z"])) == [(None, 2.0), (1.5, None)]
    assert rows(coerce_numeric(df, ["x"], fill=0)) == [(0.0, "2"), (1.5, "a")]


def test_labels(spark):
    assert [one(spark, alert_name(F.col("n")), n=n) for n in (1, 2, 3, 4, 9, None)] == [
        "verde", "amarelo", "laranja", "vermelho", "desconhecido", "desconhecido"]
    assert [one(spark, disease_name(F.col("n")), n=n) for n in ("A90", "A92.8", "Z1", None)] == ["dengue", "zika", "Z1", None]
    days = [0, int(365.25 * 5) - 1, int(365.25 * 5) + 1, 365 * 20, 365 * 40, 365 * 80]
    assert [one(spark, age_band(F.col("n")), n=n) for n in days] == ["0-4", "0-4", "5-14", "15-29", "30-59", "60+"]
    assert one(spark, age_band(F.col("n").cast("int")), n=None) == "60+"
    assert [one(spark, size_class(F.col("n")), n=n) for n in (19_999, 20_000, 99_999, 100_000)] == [
        "Pequeno", "Médio", "Médio", "Grande"]
    assert [one(spark, rt_status(F.col("n")), n=n) for n in (0.99, 1.0, 1.2, 1.21)] == [
        "Controlado", "Atenção", "Atenção", "Crescendo"]
    flags = [(1.1, 1), (1.0, 1), (1.1, 0)]
    assert [one(spark, epidemic_flag(F.col("r"), F.col("t")), r=r, t=t) for r, t in flags] == [1, 0, 0]
    assert one(spark, epidemic_flag(F.col("r").cast("double"), F.col("t")), r=None, t=1) == 0


def test_text(spark):
    assert one(spark, strip_invisible(F.col("s")), s=" ​ a b﻿ ") == "a b"
    assert one(spark, slice_text(F.col("s"), 2, 5), s="abcdefg") == "cde"
    assert [one(spark, strip_parenthesis_suffix(F.col("s")), s=s) for s in ("São Paulo (SP)", "A (B) (C)", "Plain")] == [
        "São Paulo", "A (B)", "Plain"]
    assert one(spark, contains_term(F.col("s"), "PAULO"), s="São Paulo") is True
    assert one(spark, contains_term(F.col("s").cast("string"), "x"), s=None) is False
    assert one(spark, contains_term(F.col("s"), "^s.o", regex=True), s="São Paulo") is True


def test_dates(spark):
    assert one(spark, epoch_millis_to_date(F.col("n")), n=1711065600000) == date(2024, 3, 22)
    assert one(spark, epoch_millis_to_date(F.col("n")), n=0) is None
    assert one(spark, epoch_millis_to_date(F.col("n")), n=-1) == date(1969, 12, 31)
    monday = date(2026, 3, 9)
    assert [one(spark, bucket_end(F.col("d"), f), d=monday) for f in "DWM"] == [monday, date(2026, 3, 15), date(2026, 3, 31)]
    assert one(spark, bucket_end(F.col("d"), "W"), d=date(2026, 3, 15)) == date(2026, 3, 15)
    assert one(spark, seconds_between(F.col("a"), F.col("b")), a="2026-01-01 00:00:00", b="2026-01-01 00:00:01.5") == 1.5
    assert one(spark, seconds_between(F.col("a"), F.col("b")), a="soon", b="2026-01-01 00:00:01.5") is None


def test_java_pattern():
    assert java_pattern("%Y-%m-%d") == "yyyy-M-d"
    assert java_pattern("%Y%m%d") == "yyyyMMdd"
    assert java_pattern("%d/%m/%Y %H:%M:%S") == "d/M/yyyy H:m:s"
    assert java_pattern("%YT%m") == "yyyy'T'M"
    with pytest.raises(ValueError):
        java_pattern("%Q")

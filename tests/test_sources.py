import io
import os
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from sentinela.config import LiteralColumn
from sentinela.operators.nested import field_or_null, flatten_alerts, flatten_municipalities, parse_population
from sentinela.sources.catalog import run_sql_model, table_schema
from sentinela.sources.delimited import align_header, read_aligned, read_delimited, read_without_edges
from sentinela.sources.jdbc import jdbc_query_options, jdbc_split_options, jdbc_url
from sentinela.sources.json import json_reader_options, read_json
from sentinela.sources.lines import (
    add_date_from_line, add_literal_date, cut_fixed_width, drop_edge_lines, header_line, positioned_lines, read_lines,
)
from sentinela.sources.partitions import ingestion_path
from sentinela.sources.ranges import opened
from sentinela.sources.zipped import read_zipped_csv
from tests.conftest import rows


def put(folder, name, text, encoding="utf-8"):
    with open(f"{folder}/{name}", "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode(encoding))
    return f"{folder}/{name}"


def test_delimited_with_and_without_header(spark, folder):
    put(folder, "a.csv", "id;nome\n1;São\n2;\n")
    assert rows(read_delimited(spark, folder, sep=";")) == [("1", "São"), ("2", None)]
    assert rows(read_delimited(spark, f"{folder}/a.csv", ["x", "y"], header=False, sep=";"))[0] == ("1", "São")
    with pytest.raises(ValueError):
        read_delimited(spark, folder, header=False)
    with pytest.raises(ValueError):
        read_delimited(spark, folder, sep=None)


def test_latin1(spark, folder):
    put(folder, "a.csv", "ID;NOME\n001;São Paulo\n", "latin-1")
    assert rows(read_delimited(spark, folder, sep=";", encoding="ISO-8859-1")) == [("001", "São Paulo")]
    assert rows(read_lines(spark, folder, "ISO-8859-1"))[0] == ("001;São Paulo",)


def test_header_alignment(spark, folder):
    put(folder, "a.csv", "a,b,extra\n1,2,9\n")
    got = align_header(read_delimited(spark, folder), ["B", "a", "c"])
    assert got.columns == ["B", "A", "C"] and rows(got) == [("2", "1", None)]


@pytest.mark.parametrize("second", ["b,a\n4,3\n,5\n", "a,c,b\n3,x,4\n5,,\n"])
def test_files_with_different_headers_are_bound_by_name(spark, folder, second):
    put(folder, "1.csv", 'a,b\n1,"x, y"\n')
    put(folder, "2.csv", second)
    assert rows(read_aligned(spark, folder, ["a", "b"])) == [("1", "x, y"), ("3", "4"), ("5", None)]


def test_files_with_equal_headers_are_read_together(spark, folder):
    put(folder, "1.csv", "a,b\n1,2\n")
    put(folder, "2.csv", "a,b\n3,4\n")
    assert rows(read_aligned(spark, folder, ["b", "a", "z"])) == [("2", "1", None), ("4", "3", None)]


@pytest.fixture()
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "300b")
    yield
    spark.conf.set(key, before)


def test_edge_lines_of_split_files(spark, folder, small_splits):
    """Files far larger than a split, equal lines included: exactly the edges go."""
    put(folder, "1.txt", "HEAD\n" + "same line\n" * 300 + "HEAD\n" + "TAIL " + "x" * 700 + "\n")
    put(folder, "2.txt", "same line\n" + "".join(f"row {i}\n" for i in range(200)) + "same line\n")
    put(folder, "3.txt", "only\n")
    assert read_lines(spark, folder).rdd.getNumPartitions() > 8
    lines = positioned_lines(spark, folder)
    kept = drop_edge_lines(lines, header=1, footer=True)
    counted = dict(kept.groupBy("value").count().collect())
    assert counted.pop("same line") == 300 and counted.pop("HEAD") == 1
    assert set(counted) == {f"row {i}" for i in range(200)} and set(counted.values()) == {1}
    assert drop_edge_lines(lines, header=1).count() == 303 - 1 + 202 - 1
    # More header lines than a file has, and a header longer than a split.
    assert drop_edge_lines(lines, header=2).count() == 303 - 2 + 202 - 2
    put(folder, "4.txt", "h" * 900 + "\n" + "second\n" + "third\n")
    assert "third" in [r.value for r in drop_edge_lines(positioned_lines(spark, folder), header=2).collect()]


def test_edge_lines_do_not_depend_on_how_files_are_split(spark, folder):
    """The size of splits changes between finding edges and reading rows, as with another number of executors."""
    for k in range(4):
        put(folder, f"{k}.txt", "HEAD\n" + "".join(f"{k} {i}\n" for i in range(3000)) + "TAIL\n")
    key, want = "spark.sql.files.maxPartitionBytes", sorted(f"{k} {i}" for k in range(4) for i in range(3000))
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "500b")
        lines = positioned_lines(spark, folder)
        kept = drop_edge_lines(lines, header=1, footer=True)
        heads = header_line(lines)
        spark.conf.set(key, "7k")
        assert sorted(r.value for r in kept.collect()) == want
        assert [r._line for r in heads.collect()] == ["HEAD"] * 4
        dated = add_date_from_line(kept, lines, LiteralColumn("d", "yyyyMMdd", line=1, start=0, end=8))
        spark.conf.set(key, "1g")
        assert dated.count() == len(want)
    finally:
        spark.conf.set(key, before)


def test_header_line_and_dates_from_it(spark, folder, small_splits):
    put(folder, "1.txt", "H1 20260417\nH2 31/12/2025\n" + "AAABBB\n" * 100)
    put(folder, "2.txt", "H1 20260501\nH2 01/01/2026\n" + "CCCDDD\n" * 50)
    lines = positioned_lines(spark, folder)
    assert [r[0] for r in rows(header_line(lines, 1), "_line")] == ["H2 01/01/2026", "H2 31/12/2025"]
    kept = drop_edge_lines(lines, header=1)
    first = add_date_from_line(kept, lines, LiteralColumn("d", "yyyyMMdd", line=0, start=3, end=11))
    assert dict(first.groupBy("d").count().collect()) == {date(2026, 4, 17): 101, date(2026, 5, 1): 51}
    second = add_date_from_line(kept, lines, LiteralColumn("d", "dd/MM/yyyy", line=1, start=3, end=13))
    assert dict(second.groupBy("d").count().collect()) == {date(2025, 12, 31): 101, date(2026, 1, 1): 51}


def test_differing_headers_with_line_breaks_in_quotes(spark, folder):
    put(folder, "1.csv", 'a,b\n1,"two\nlines"\n2,x\n')
    put(folder, "2 of.csv", 'b,a\n"three\nmore\nlines",3\n')
    got = rows(read_aligned(spark, folder, ["a", "b"], multiLine=True), "A", "B")
    assert got == [("1", "two\nlines"), ("2", "x"), ("3", "three\nmore\nlines")]


def test_fixed_width(spark):
    df = spark.createDataFrame([("001 Ana  M9",), ("002Bruna F",)], "value string")
    cut = cut_fixed_width(df, [("id", 0, 3), ("nome", 3, 9), ("sexo", 9, 10), ("x", 10, 11)], positional=("nome",))
    assert rows(cut) == [("001", " Ana  ", "M", "9"), ("002", "Bruna ", "F", "")]


def test_literal_date(spark):
    got = add_literal_date(spark.range(1), LiteralColumn("d", "dd/MM/yyyy", value="09/03/2026"))
    assert got.first()["d"] == date(2026, 3, 9)


def test_json_options():
    options = json_reader_options({"multiline": False, "line_sep": "\n", "primitive_as_string": True})
    assert options["multiLine"] == "false" and options["lineSep"] == "\n" and options["primitivesAsString"] == "true"
    assert "lineSep" not in json_reader_options()
    assert json_reader_options({"use_unsafe_row": True}) == json_reader_options()
    with pytest.raises(ValueError):
        json_reader_options({"no_such_option": True})


def test_json_document_with_an_array(spark, folder):
    put(folder, "a.json", '{"meta": 1,\n "itens": [{"a": 1, "b": "x"}, {"a": 2}]}')
    assert rows(read_json(spark, folder, explode_column="itens")) == [(1, "x"), (2, None)]


def test_ingestion_path():
    assert ingestion_path("s3://b/t/", "2026-01-02") == "s3://b/t/ingestion_date=2026-01-02/"
    assert ingestion_path("/b/t", "2026-01-02", "None") == "/b/t/ingestion_date=2026-01-02/"
    assert ingestion_path("/b/t", "2026-01-02", "f.csv") == "/b/t/ingestion_date=2026-01-02/f.csv"


def test_zip(spark, folder):
    def archive(name, members):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for member, text in members.items():
                z.writestr(member, text.encode("latin-1"))
        put(folder, name, packed.getvalue())

    archive("1.zip", {"leia.txt": "x", "D.CSV": "ID;NOME\n001;São Paulo\n002;\n", "z.csv": "ID\n9\n"})
    archive("2.zip", {"d.csv": "nome;id;mais\nItu;003;1\n"})
    got = read_zipped_csv(spark, folder, ["id", "nome"], sep=";")
    assert rows(got) == [("001", "São Paulo"), ("002", None), ("003", "Itu")]
    archive("3.zip", {"leia.txt": "x"})
    with pytest.raises(Exception, match="no CSV file"):
        read_zipped_csv(spark, folder, ["id"]).collect()


def test_zip_beyond_two_gigabytes_is_read_by_ranges(spark, folder):
    """An archive that begins after a hole of 2.2 GB; a member of 60 MB leaves the task in batches."""
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z, z.open("a.csv", "w") as member:
        member.write(b"ID,NOME\n")
        for i in range(60):
            member.write(b"7," + b"x" * 998 + b"\n" if i % 2 else (b"8," + b"y" * 98 + b"\n") * 10_000)
    with open(f"{folder}/large of.zip", "wb") as f:
        f.seek(2_200_000_000)
        f.write(packed.getvalue())
    assert os.stat(f"{folder}/large of.zip").st_blocks * 512 < 10_000_000
    got = read_zipped_csv(spark, folder, ["nome", "id"])
    assert {r[0]: r["n"] for r in got.groupBy("ID").agg(F.count("*").alias("n")).collect()} == {"7": 30, "8": 300_000}


def test_ranges_are_those_of_the_file(folder):
    data = bytes(range(256)) * 700
    path = put(folder, "a b.bin", data)
    with opened(f"file://{path}".replace(" ", "%20"), 100) as f:
        assert f.read(10) == data[:10] and f.seek(-5, 2) == len(data) - 5 and f.read() == data[-5:] and f.read() == b""
        assert f.seek(1000) == 1000 and f.read(70_000) == data[1000:71_000] and f.seek(-10, 1) == 70_990 and f.read(3) == data[70_990:70_993]


def test_jdbc_options():
    assert jdbc_url("PostgreSQL", "h", 5432, "d") == "jdbc:postgresql://h:5432/d"
    assert jdbc_url("oracle", "h", "1521", "d") == "jdbc:oracle:thin:@//h:1521/d"
    assert jdbc_url("sqlserver", "h", 1433, "d") == "jdbc:sqlserver://h:1433;databaseName=d"
    with pytest.raises(ValueError):
        jdbc_url("mysql", "h", 1, "d")
    assert jdbc_query_options("u", "SELECT 1", "me", "pw")["query"] == "SELECT 1"
    split = jdbc_split_options("u", "SELECT a FROM t", "me", "pw", "a", 0, 100, 8)
    assert split["dbtable"] == "(SELECT a FROM t) q" and split["numPartitions"] == "8" and "query" not in split


def test_sql_model(spark):
    df = spark.range(10)
    assert run_sql_model(spark, "SELECT count(*) AS n FROM {t} WHERE id >= :low", {"low": 4}, t=df).first()[0] == 6
    for empty in ("", "  \n", None):
        with pytest.raises(ValueError):
            run_sql_model(spark, empty)
    assert table_schema(df) == [("id", "bigint")]


def test_places_with_and_without_a_region(spark, folder):
    put(folder, "a.json", """[
      {"id": 41, "nome": "Barra", "microrregiao": {"nome": "Litoral", "mesorregiao": {"nome": "Leste"}}},
      {"id": 42, "nome": "Ilha", "microrregiao": {"nome": "Mar", "mesorregiao": null}},
      {"id": 43, "nome": "Morro", "microrregiao": null}]""")
    assert rows(flatten_municipalities(read_json(spark, folder))) == [
        (41, "Barra", "Litoral", "Leste"), (42, "Ilha", "Mar", None), (43, "Morro", None, None)]


def test_places_none_of_which_has_a_region(spark, folder):
    put(folder, "a.json", '[{"id": 8, "nome": "Morro"}, {"id": 9, "nome": null}]')
    df = read_json(spark, folder)
    assert rows(flatten_municipalities(df)) == [(8, "Morro", None, None), (9, None, None, None)]
    assert {r[0] for r in df.select(field_or_null(df, "nome.parte").alias("x")).collect()} == {None}


def test_population_records(spark):
    """The title record goes; a suffix in brackets goes; a figure that is no number is unknown."""
    df = spark.createDataFrame(
        [("512", "77", "Lago (PR)", "1999"), ("Valor", "Município (Código)", "Município", "Ano (Código)"), ("-", "78", "Serra", "1999")],
        "V string, D1C string, D1N string, D3C string")
    assert rows(parse_population(df)) == [(77, "Lago", 512, 1999), (78, "Serra", None, 1999)]


def test_alert_records(spark, folder):
    """Weeks are cut from their number, dates come from milliseconds, absent fields are unknown or zero."""
    noon = 43_200_000
    put(folder, "a.json", f"""[
      {{"SE": 199953, "data_iniSE": {86_400_000 * 10_957 + noon}, "casos": 4, "casos_est": 6.25, "Rt": 0.5, "p_inc100k": 3,
        "nivel": 1, "receptivo": 0, "transmissao": 1, "tempmin": -2.5}},
      {{"SE": 200007, "data_iniSE": 0, "casos": 9}}, {{"nivel": 4}}]""")
    got = flatten_alerts(read_json(spark, folder), F.lit("zika"), F.lit(12)).collect()
    by_week = {(r["nr_ano_epi"], r["nr_semana_epi"]): r for r in got}
    assert set(by_week) == {(1999, 53), (2000, 7), (0, 0)} and len(got[0]) == 19
    full, dateless, bare = by_week[(1999, 53)], by_week[(2000, 7)], by_week[(0, 0)]
    assert full["dt_semana_epidemiologica"] == date(2000, 1, 1) and dateless["dt_semana_epidemiologica"] is None
    assert (full["vl_casos"], full["vl_casos_estimados"], full["vl_rt"], full["vl_temp_min"]) == (4, 6.25, 0.5, -2.5)
    assert (bare["nr_nivel_alerta"], bare["cd_geocode"], bare["ds_doenca"]) == (4, 12, "zika")


def test_rows_without_first_and_last_data_line(spark, folder, small_splits):
    put(folder, "1.csv", "a;b\nunits;kg\n" + "1;x\n" * 200 + "total;200\n")
    put(folder, "2.csv", "b;a\nkg;units\ny;2\nend;\n")
    got = read_without_edges(positioned_lines(spark, folder), ["a", "b"], True, ";", skip_first=True, skip_last=True).drop("_file", "_block")
    assert dict((tuple(r)[:2], r["count"]) for r in got.groupBy("A", "B").count().collect()) == {("1", "x"): 200, ("2", "y"): 1}
    bare = read_without_edges(positioned_lines(spark, f"{folder}/2.csv"), ["p", "q"], False, ";", skip_last=True).drop("_file", "_block")
    assert rows(bare) == [("b", "a"), ("kg", "units"), ("y", "2")]

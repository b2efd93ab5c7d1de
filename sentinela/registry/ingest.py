"""Sources, casts, filters, nested input, sinks and the two jobs, on renderings of the given tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sentinela.config import IngestSpec, LiteralColumn, QualitySpec, RefineSpec, parse_schema
from sentinela.operators.casting import cast_frame, coerce_numeric
from sentinela.operators.filters import filter_dates, filter_value
from sentinela.operators.nested import flatten_alerts, flatten_municipalities, parse_population
from sentinela.plans import gold
from sentinela.plans.defaults import INGEST_PARTITION, SUITES, create_table, ingest_schema
from sentinela.plans.jobs import bronze_to_silver, silver_to_gold
from sentinela.registry.base import Tables, query
from sentinela.sinks.files import land_json, write_csv, write_parquet
from sentinela.sinks.runlog import RunLog, read_runs
from sentinela.sinks.tables import insert_into, upsert_into
from sentinela.sources.delimited import align_header, read_aligned, read_delimited
from sentinela.sources.json import explode_rows, read_json
from sentinela.sources.lines import (
    add_date_from_line, add_literal_date, cut_fixed_width, drop_edge_lines, positioned_lines, read_lines,
)
from sentinela.sources.partitions import ingestion_path
from sentinela.sources.zipped import read_zipped_csv
from sentinela.staging import scratch_path

ORDER_SCHEMA = {
    "o_orderkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": ["date", "yyyy-MM-dd"], "o_orderpriority": "string",
}
ORDER_NAMES = list(ORDER_SCHEMA)
ORDER_SQL = ("SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, "
             "o_orderpriority FROM orders")


def order_texts(t: Tables) -> DataFrame:
    """Orders as a delimited source would deliver them: all text."""
    return t.orders.select(*[
        (F.date_format(c, "yyyy-MM-dd") if c == "o_orderdate" else F.col(c).cast("string")).alias(c)
        for c in ORDER_NAMES])


def typed_orders(df: DataFrame) -> DataFrame:
    return cast_frame(df, parse_schema(ORDER_SCHEMA))


def order_lines(t: Tables) -> DataFrame:
    """Orders as fixed-width lines."""
    return order_texts(t).select(F.concat(
        F.lpad("o_orderkey", 20, "0"), F.rpad("o_orderstatus", 3, " "), F.lpad("o_totalprice", 16, " "),
        F.regexp_replace("o_orderdate", "-", ""), F.rpad("o_orderpriority", 16, " ")).alias("value"))


ORDER_LAYOUT = [("o_orderkey", 0, 20), ("o_orderstatus", 20, 23), ("o_totalprice", 23, 39),
                ("o_orderdate", 39, 47), ("o_orderpriority", 47, 63)]


# Sources

@query("scan_csv_header", ORDER_SQL)
def _(t):
    path = scratch_path(t.spark, "csv")
    order_texts(t).write.options(header=True, sep=";").csv(path)
    return typed_orders(read_delimited(t.spark, path, sep=";"))


@query("scan_csv_no_header", ORDER_SQL)
def _(t):
    path = scratch_path(t.spark, "csv")
    order_texts(t).write.options(sep="|").csv(path)
    return typed_orders(read_delimited(t.spark, path, ORDER_NAMES, header=False, sep="|"))


@query("scan_text_lines", """
SELECT CAST(o_orderkey AS VARCHAR) || ' ' || o_orderstatus || ' ' || o_orderpriority AS value FROM orders""")
def _(t):
    path = scratch_path(t.spark, "txt")
    t.orders.select(F.concat_ws(" ", "o_orderkey", "o_orderstatus", "o_orderpriority").alias("value")).write.text(path)
    return read_lines(t.spark, path)


@query("scan_fixed_width", ORDER_SQL)
def _(t):
    path = scratch_path(t.spark, "txt")
    order_lines(t).write.text(path)
    cut = cut_fixed_width(read_lines(t.spark, path), ORDER_LAYOUT)
    return cast_frame(cut, parse_schema({**ORDER_SCHEMA, "o_orderdate": ["date", "yyyyMMdd"]}))


@query("schema_align", """
SELECT o_orderkey AS "O_ORDERKEY", o_orderstatus AS "O_ORDERSTATUS",
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS "O_ORDERPRIORITY" FROM orders""")
def _(t):
    path = scratch_path(t.spark, "csv")
    texts = order_texts(t)
    done, rest = texts.filter("o_orderstatus = 'F'"), texts.filter("o_orderstatus <> 'F'")
    done.select("o_orderstatus", "o_totalprice", "o_orderkey").write.options(header=True).csv(path)
    rest.select("o_orderkey", "o_orderpriority", "o_orderstatus").write.mode("append").options(header=True).csv(path)
    aligned = read_aligned(t.spark, path, ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    return aligned.withColumn("O_ORDERKEY", F.col("O_ORDERKEY").cast("bigint"))


@query("scan_json", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = scratch_path(t.spark, "json")
    t.customer.write.json(path)
    found = read_json(t.spark, path, multiline=False)
    return found.select("c_custkey", "c_name", F.col("c_nationkey").cast("int"), "c_acctbal", "c_mktsegment")


PRIORITY_DATES = {"1-URGENT": "2026-01-01", "2-HIGH": "2026-02-01", "3-MEDIUM": "2026-03-01",
                  "4-NOT SPECIFIED": "2026-04-01", "5-LOW": "2026-05-01"}


@query("scan_ingestion_partition", "SELECT o_orderkey, o_orderstatus, CASE o_orderpriority " + " ".join(
    f"WHEN '{p}' THEN '{d}'" for p, d in PRIORITY_DATES.items()) + " END AS dt_ref FROM orders")
def _(t):
    """All orders, landed by priority and read one ingestion date at a time."""
    root = scratch_path(t.spark, "landing")
    dates = F.create_map(*[F.lit(x) for pair in PRIORITY_DATES.items() for x in pair])
    t.orders.select("o_orderkey", "o_orderstatus", dates[F.col("o_orderpriority")].alias("ingestion_date")).write.partitionBy(
        "ingestion_date").json(root)
    parts = [
        read_json(t.spark, ingestion_path(root, d, "none"), schema="o_orderkey long, o_orderstatus string", multiline=False)
        .withColumn("dt_ref", F.lit(d)) for d in PRIORITY_DATES.values()]
    return reduce(DataFrame.union, parts)


@query("scan_zip_csv", ORDER_SQL)
def _(t):
    """Archives are written to the shared folder and read as files."""
    names, root = ORDER_NAMES, scratch_path(t.spark, "zip")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = fs.FileSystem.from_uri(root)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("leia-me.txt", "dados")
                archive.writestr("dados.csv", batch[names[::-1]].to_csv(index=False).encode("latin-1"))
            name = f"{folder}/{TaskContext.get().partitionId()}-{batch['o_orderkey'].iloc[0]}.zip"
            with system.open_output_stream(name) as sink:
                sink.write(packed.getvalue())
            yield pd.DataFrame({"rows": [len(batch)]})

    order_texts(t).mapInPandas(pack, "rows long").agg(F.sum("rows")).collect()
    return typed_orders(read_zipped_csv(t.spark, root, names))


# Casts and filters

@query("cast_schema", ORDER_SQL)
def _(t):
    padded = order_texts(t).select(*[F.concat(F.lit("  "), F.col(c), F.lit(" ")).alias(c.upper()) if c != "o_orderdate"
                                     else F.col(c).alias(c.upper()) for c in ORDER_NAMES])
    return cast_frame(padded, parse_schema(ORDER_SCHEMA), partition_column="o_orderdate")


@query("cast_decimal", """
SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,1)) AS DOUBLE) AS l_extendedprice,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS l_quantity FROM lineitem""")
def _(t):
    text = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("string"),
        F.when(F.col("l_returnflag") == "R", "n/a").otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"))
    cast = cast_frame(text, parse_schema({"l_orderkey": "bigint", "l_linenumber": "int",
                                          "l_extendedprice": "decimal(12,1)", "l_quantity": "decimal(10,2)"}))
    return cast.withColumns({c: F.col(c).cast("double") for c in ("l_extendedprice", "l_quantity")})


@query("cast_date_mask", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS ts FROM orders""")
def _(t):
    open_text = F.when(F.col("o_orderstatus") == "P", "pendente")
    text = t.orders.select("o_orderkey", open_text.otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("d"),
                           open_text.otherwise(F.date_format("o_orderdate", "yyyyMMddHHmmss")).alias("ts"))
    cast = cast_frame(text, parse_schema({"o_orderkey": "bigint", "d": ["date", "dd/MM/yyyy"],
                                          "ts": ["timestamp", "yyyyMMddHHmmss"]}))
    return cast.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("cast_renamed_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dt_pedido FROM orders")
def _(t):
    return cast_frame(order_texts(t), parse_schema({
        "o_orderkey": "bigint", "dt_pedido": ["o_orderdate", "date", "yyyy-MM-dd"]}))


@query("cast_comma_decimal", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem")
def _(t):
    comma = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    text = t.lineitem.select("l_orderkey", "l_linenumber", comma.alias("l_extendedprice"),
                             F.col("l_discount").cast("string").alias("l_discount"))
    return cast_frame(text, parse_schema({"l_orderkey": "bigint", "l_linenumber": "int",
                                          "l_extendedprice": "double", "l_discount": "double"}))


@query("cast_trim", "SELECT p_partkey, p_name, ' ' || p_brand || ' ' AS p_brand FROM part")
def _(t):
    padded = t.part.select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"),
                           F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("p_brand"))
    return cast_frame(padded, parse_schema({"p_partkey": "bigint", "p_name": "string", "p_brand": "string"}),
                      positional=["p_brand"])


@query("coerce_numeric", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value FROM events""")
def _(t):
    text = t.events.select("event_id", F.when(F.col("event_type") == "error", "erro")
                           .otherwise(F.col("value").cast("string")).alias("value"))
    return coerce_numeric(text, ["value", "no_such_column"], fill=0.0)


@query("lit_date", "SELECT o_orderkey, DATE '2026-03-09' AS dt_carga FROM orders")
def _(t):
    return add_literal_date(t.orders.select("o_orderkey"), LiteralColumn("dt_carga", "dd/MM/yyyy", value="09/03/2026"))


def _with_edges(lines: DataFrame, header: str | None, footer: str | None) -> DataFrame:
    """Put a line before and after the lines of every file that will be written."""
    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if header is not None:
            yield pd.DataFrame({"value": [header]})
        yield from batches
        if footer is not None:
            yield pd.DataFrame({"value": [footer]})

    return lines.mapInPandas(wrap, "value string")


def _landed_lines(t: Tables, header: str | None = None, footer: str | None = None) -> str:
    path = scratch_path(t.spark, "txt")
    _with_edges(order_lines(t), header, footer).write.text(path)
    return path


@query("lit_from_row", "SELECT o_orderkey, DATE '2026-04-17' AS dt_arquivo FROM orders")
def _(t):
    path = _landed_lines(t, header="00ARQ 20260417 PEDIDOS")
    literal = LiteralColumn("dt_arquivo", "yyyyMMdd", line=0, start=6, end=14)
    lines = positioned_lines(t.spark, path)
    dated = add_date_from_line(drop_edge_lines(lines, header=1), lines, literal)
    return cut_fixed_width(dated.drop("_file", "_block", "_place"), ORDER_LAYOUT[:1]).select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "dt_arquivo")


@query("skip_header_row", "SELECT o_orderkey FROM orders")
def _(t):
    path = _landed_lines(t, header="CABECALHO")
    kept = drop_edge_lines(positioned_lines(t.spark, path), header=1)
    return kept.select(F.substring("value", 1, 20).cast("bigint").alias("o_orderkey"))


@query("skip_footer_row", "SELECT o_orderkey FROM orders")
def _(t):
    path = _landed_lines(t, header="CABECALHO", footer="TOTAL 999")
    kept = drop_edge_lines(positioned_lines(t.spark, path), header=1, footer=True)
    return kept.select(F.substring("value", 1, 20).cast("bigint").alias("o_orderkey"))


@query("filter_eq", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'")
def _(t):
    return filter_value(t.orders, "o_orderpriority", "2-HIGH").select("o_orderkey")


@query("filter_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue).*t')")
def _(t):
    return filter_value(t.part, "p_name", "*re^(red|blue).*t").select("p_partkey", "p_name")


@query("filter_date_range", """
SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'
UNION ALL SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:00'""")
def _(t):
    text = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "sem data")
                           .otherwise(F.col("o_orderdate").cast("string")).alias("o_orderdate"))
    closed = filter_dates(text, "o_orderdate", "1996-01-01", "1997-12-31").select("o_orderkey")
    return closed.unionAll(filter_dates(t.orders, "o_orderdate", datetime(2000, 1, 1)).select("o_orderkey"))


# Nested input

@query("explode_flatten", """
SELECT o_orderkey AS chave, o_orderstatus AS valor FROM orders
UNION ALL SELECT o_orderkey, o_orderpriority FROM orders""")
def _(t):
    items = F.array(*[F.struct(F.col("o_orderkey").alias("chave"), F.col(c).alias("valor"))
                      for c in ("o_orderstatus", "o_orderpriority")])
    path = scratch_path(t.spark, "json")
    t.orders.select(F.lit("ok").alias("situacao"), items.alias("itens")).write.json(path)
    return read_json(t.spark, path, explode_column="itens", multiline=False)


@query("flatten_municipality", """
SELECT s_suppkey AS cd_geocode, s_name AS nm_municipio,
       CASE WHEN r_name <> 'ASIA' THEN n_name END AS nm_microrregiao,
       CASE WHEN r_name <> 'ASIA' THEN r_name END AS nm_mesorregiao
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    micro = F.struct(F.col("n_name").alias("nome"), F.struct(F.col("r_name").alias("nome")).alias("mesorregiao"))
    documents = joined.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("nome"),
                              F.when(F.col("r_name") != "ASIA", micro).alias("microrregiao"))
    path = scratch_path(t.spark, "json")
    documents.write.json(path)
    return flatten_municipalities(read_json(t.spark, path, multiline=False))


@query("parse_population", """
SELECT cd_geocode, 'Lugar (' || cd_geocode || ')' AS nm_municipio, vl_populacao, dt_ano_referencia FROM v_populacao""")
def _(t):
    text = lambda c: F.col(c).cast("string")
    records = t.population.select(
        text("vl_populacao").alias("V"), text("cd_geocode").alias("D1C"),
        F.concat(F.lit("Lugar ("), text("cd_geocode"), F.lit(") (SP)")).alias("D1N"),
        text("dt_ano_referencia").alias("D3C"))
    titles = t.region.filter("r_name = 'ASIA'").select(
        F.lit("Valor").alias("V"), F.lit("Município (Código)").alias("D1C"), F.lit("Município").alias("D1N"),
        F.lit("Ano (Código)").alias("D3C"))
    return parse_population(titles.unionByName(records))


@query("flatten_alert", """
SELECT cd_geocode, ds_doenca, dt_semana_epidemiologica, nr_semana_epi, nr_ano_epi, nr_nivel_alerta,
       vl_casos_estimados, CAST(NULL AS DOUBLE) AS vl_casos_estimados_min, vl_casos, vl_rt, vl_incidencia,
       vl_temp_min, vl_umid_max, vl_receptividade, vl_transmissao FROM v_alertas""")
def _(t):
    documents = t.alerts.select(
        F.col("cd_geocode").alias("geocode"), F.col("ds_doenca").alias("disease"),
        (F.col("nr_ano_epi") * 100 + F.col("nr_semana_epi")).alias("SE"),
        (F.unix_date("dt_semana_epidemiologica").cast("bigint") * 86_400_000).alias("data_iniSE"),
        F.col("nr_nivel_alerta").alias("nivel"), F.col("vl_casos_estimados").alias("casos_est"),
        F.col("vl_casos").alias("casos"), F.col("vl_rt").alias("Rt"), F.col("vl_incidencia").alias("p_inc100k"),
        F.col("vl_temp_min").alias("tempmin"), F.col("vl_umid_max").alias("umidmax"),
        F.col("vl_receptividade").alias("receptivo"), F.col("vl_transmissao").alias("transmissao"))
    return flatten_alerts(documents).select(
        "cd_geocode", "ds_doenca", "dt_semana_epidemiologica", "nr_semana_epi", "nr_ano_epi", "nr_nivel_alerta",
        "vl_casos_estimados", "vl_casos_estimados_min", "vl_casos", "vl_rt", "vl_incidencia", "vl_temp_min",
        "vl_umid_max", "vl_receptividade", "vl_transmissao")


# Sinks

def _order_table(t: Tables) -> tuple[str, str]:
    """An empty table partitioned by status, in the shared folder; returns name and location."""
    location = scratch_path(t.spark, "table")
    name = "t_" + location.rsplit("-", 1)[1]
    t.spark.sql(f"CREATE TABLE {name} (o_orderkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING) "
                f"USING parquet PARTITIONED BY (o_orderstatus) LOCATION '{location}'")
    return name, location


def _orders_for_table(t: Tables, **replace) -> DataFrame:
    df = t.orders.select("o_orderstatus", "o_orderkey", "o_totalprice")
    return df.withColumns(replace) if replace else df


def _table_rows(t: Tables, name: str, location: str) -> DataFrame:
    """The rows the table ended up with, its catalog entry removed."""
    t.spark.sql(f"DROP TABLE {name}")
    return t.spark.read.parquet(location).select("o_orderkey", "o_totalprice", "o_orderstatus")


TABLE_SQL = "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders"


@query("sink_append", f"{TABLE_SQL} UNION ALL {TABLE_SQL} WHERE o_orderstatus = 'F'")
def _(t):
    name, location = _order_table(t)
    insert_into(_orders_for_table(t), name, "append")
    insert_into(_orders_for_table(t).filter("o_orderstatus = 'F'"), name, "append")
    return _table_rows(t, name, location)


@query("sink_overwrite", f"{TABLE_SQL} WHERE o_orderstatus = 'F'")
def _(t):
    name, location = _order_table(t)
    insert_into(_orders_for_table(t), name, "append")
    insert_into(_orders_for_table(t).filter("o_orderstatus = 'F'"), name, "overwrite", partitions="static")
    return _table_rows(t, name, location)


@query("sink_dynamic_overwrite", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus
FROM orders""")
def _(t):
    name, location = _order_table(t)
    insert_into(_orders_for_table(t), name, "append")
    zeroed = _orders_for_table(t, o_totalprice=F.lit(0.0)).filter("o_orderstatus = 'F'")
    insert_into(zeroed, name, "overwrite", partitions="dynamic")
    return _table_rows(t, name, location)


@query("upsert_merge", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -1.0 END AS o_totalprice, o_orderstatus
FROM orders""")
def _(t):
    name, location = _order_table(t)
    insert_into(_orders_for_table(t).filter("o_orderstatus <> 'P'"), name, "append")
    changed = _orders_for_table(t, o_totalprice=F.lit(-1.0)).filter("o_orderstatus <> 'F'")
    upsert_into(changed, name, ["o_orderkey"])
    return _table_rows(t, name, location)


@query("sink_csv_roundtrip", f"SELECT *, (SELECT count(*) FROM orders) AS written FROM ({ORDER_SQL})")
def _(t):
    path = scratch_path(t.spark, "csv")
    written = write_csv(order_texts(t), path, sep=";")
    return typed_orders(read_delimited(t.spark, path, sep=";")).withColumn("written", F.lit(written).cast("bigint"))


@query("sink_parquet_roundtrip", "SELECT *, (SELECT count(*) FROM lineitem) AS written FROM lineitem")
def _(t):
    path = scratch_path(t.spark, "parquet")
    written = write_parquet(t.lineitem, path, ["l_returnflag"])
    back = t.spark.read.parquet(path).select(*t.lineitem.columns)
    return back.withColumn("written", F.lit(written).cast("bigint"))


@query("land_json_roundtrip", """
SELECT c_custkey, c_name, c_acctbal, DATE '2026-02-01' AS ingestion_date FROM customer""")
def _(t):
    root = scratch_path(t.spark, "landing")
    land_json(t.customer.select("c_custkey", "c_name", "c_acctbal"), root, "2026-02-01")
    return read_json(t.spark, root, multiline=False).select("c_custkey", "c_name", "c_acctbal", "ingestion_date")


# Jobs

def _order_job(t: Tables) -> tuple[IngestSpec, QualitySpec, str]:
    """Orders landed as CSV, and what the job needs to know about them."""
    root = scratch_path(t.spark, "bronze")
    texts = order_texts(t)
    texts.select(*ORDER_NAMES[::-1]).write.options(header=True, sep=",").csv(f"{root}/ingestion_date=2026-02-01")
    location = scratch_path(t.spark, "silver")
    table = "t_" + location.rsplit("-", 1)[1]
    t.spark.sql(f"CREATE TABLE {table} (o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
                f"o_orderdate DATE, o_orderpriority STRING, dt_carga DATE) "
                f"USING parquet PARTITIONED BY (dt_carga) LOCATION '{location}'")
    spec = IngestSpec.parse({
        "trgt_tbl": "vendas_tb_pedidos", "ext": "csv", "sep": ",", "header": "True", "bronze_path": root,
        "silver_table": table, "table_schema": str(ORDER_SCHEMA), "options_params": {"normalize_schema": True},
        "lit_values": {"column_name": "dt_carga", "mask": "yyyy-MM-dd", "value": "dt_ref", "dt_type": "date",
                       "variable": True},
        "partition_column": "dt_carga", "filter_column": "o_orderpriority", "filter_value": "*re^[1-3]-",
        "has_bdq": True, "critical": True,
    })
    quality = QualitySpec.parse({"trgt_tbl": "vendas_tb_pedidos", "stop_job": False, "quality_params": {
        "not_null": {"column": "o_orderkey,o_orderdate"}, "unique_vals": {"column": "O_ORDERKEY"},
        "values_to_be_in_set": {"column": "o_orderstatus", "type": "str", "set_values": [["O", "F"]]}}})
    return spec, quality, location


def _run_order_job(t: Tables) -> tuple[str, str]:
    spec, quality, location = _order_job(t)
    logs = scratch_path(t.spark, "logs")
    log = RunLog(t.spark, logs, "bronze_to_silver", spec.target, "silver", critical=spec.critical)
    bronze_to_silver(t.spark, spec, "2026-02-01", quality=quality, log=log)
    t.spark.sql(f"DROP TABLE {spec.silver_table}")
    return location, logs


@query("ingest_bronze_silver", f"""
SELECT *, DATE '2026-02-01' AS dt_carga FROM ({ORDER_SQL}) WHERE o_orderpriority < '4'""")
def _(t):
    location, _ = _run_order_job(t)
    return t.spark.read.parquet(location)


@query("log_write", """
SELECT 'vendas' AS source, 'tb_pedidos' AS table_name, 'bronze_to_silver' AS job_name, 'silver' AS layer,
       CASE WHEN count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) > 0 THEN 'warning' ELSE 'success' END
           AS status,
       true AS has_bdq, true AS critical_table, count(*) AS count
FROM orders WHERE o_orderpriority < '4'""")
def _(t):
    _, logs = _run_order_job(t)
    return read_runs(t.spark, logs).select("source", "table_name", "job_name", "layer", "status", "has_bdq",
                                           "critical_table", "count")


@query("dq_log_write", """
SELECT unnest(['o_orderkey', 'o_orderdate', 'O_ORDERKEY', 'o_orderstatus']) AS column_tested,
       unnest(['success', 'success', 'success', CASE WHEN n > 0 THEN 'failure' ELSE 'success' END]) AS status
FROM (SELECT count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS n FROM orders WHERE o_orderpriority < '4')""")
def _(t):
    _, logs = _run_order_job(t)
    tests = read_runs(t.spark, logs).select(F.explode("quality_tests").alias("q"))
    return tests.select("q.column_tested", "q.status")


@query("refine_silver_gold", "SELECT * FROM g_profile")
def _(t):
    location = scratch_path(t.spark, "gold")
    t.spark.sql("CREATE DATABASE IF NOT EXISTS gold")
    table = "g" + location.rsplit("-", 1)[1]
    model = gold.demographic_profile(t.notifications, t.municipalities)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in model.schema.fields)
    t.spark.sql(f"CREATE TABLE gold.{table} ({columns}) USING parquet "
                f"PARTITIONED BY (nr_ano_notificacao, nr_mes_notificacao) LOCATION '{location}'")
    silver_to_gold(t.spark, RefineSpec.parse({"target_table": f"gold_{table}", "layer": "gold", "mode": "overwrite"}),
                   lambda: model)
    t.spark.sql(f"DROP TABLE gold.{table}")
    return t.spark.read.parquet(location)


def _silver(t: Tables, table: str, bronze: str, ext: str, suffix: str) -> tuple[str, str]:
    """Ingest one landed table with its declared schema and checks; returns catalog name and location."""
    name, location = f"silver.{table}_{suffix}", scratch_path(t.spark, table)
    create_table(t.spark, name, table, location, wide=True)
    spec = IngestSpec.parse({
        "trgt_tbl": f"monitor_{table}", "ext": ext, "sep": ",", "bronze_path": bronze, "silver_table": name,
        "table_schema": ingest_schema(table, wide=True), "partition_column": INGEST_PARTITION[table],
        "options_params": {"normalize_schema": True} if ext == "csv" else {"multiline": False}, "has_bdq": True})
    quality = QualitySpec.parse({"trgt_tbl": f"monitor_{table}", "quality_params": SUITES[table]})
    bronze_to_silver(t.spark, spec, "2026-02-01", quality=quality)
    return name, location


@query("refine_stored_sql", """
SELECT ds_doenca, nr_ano_epi, count(DISTINCT cd_geocode) AS municipios, sum(vl_casos) AS casos
FROM v_alertas WHERE vl_casos >= 2 GROUP BY ALL""")
def _(t):
    """A gold model kept as SQL text, with a parameter, through the job."""
    text = """SELECT count(DISTINCT cd_geocode) AS municipios, sum(vl_casos) AS casos, nr_ano_epi, ds_doenca
              FROM {alertas} WHERE vl_casos >= :minimo GROUP BY ds_doenca, nr_ano_epi"""
    location = scratch_path(t.spark, "gold")
    t.spark.sql("CREATE DATABASE IF NOT EXISTS gold")
    table = "s" + location.rsplit("-", 1)[1]
    t.spark.sql(f"CREATE TABLE gold.{table} (municipios BIGINT, casos BIGINT, nr_ano_epi BIGINT, ds_doenca STRING) "
                f"USING parquet PARTITIONED BY (ds_doenca) LOCATION '{location}'")
    silver_to_gold(t.spark, RefineSpec.parse({"target_table": f"gold_{table}"}), text, {"minimo": 2}, {"alertas": t.alerts})
    result = t.spark.read.schema(t.spark.table(f"gold.{table}").schema).parquet(location)
    t.spark.sql(f"DROP TABLE gold.{table}")
    return result.withColumn("nr_ano_epi", F.col("nr_ano_epi").cast("int"))


@query("medallion_ranking", "SELECT * FROM g_ranking")
def _(t):
    """Landed records to silver tables to the gold ranking, every step through the two jobs."""
    suffix = scratch_path(t.spark, "run").rsplit("-", 1)[1]
    for database in ("silver", "gold"):
        t.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    landed = {
        "tb_municipios": t.municipalities,
        "tb_populacao": t.population.withColumn("nm_municipio", F.lit("Lugar")),
        "tb_alertas": t.alerts.withColumns({
            "vl_casos_estimados_min": F.col("vl_casos_estimados") - 1,
            "vl_casos_estimados_max": F.col("vl_casos_estimados") + 1, "nm_municipio": F.lit("Lugar")}),
    }
    silver, tables = {}, []
    for table, records in landed.items():
        bronze = scratch_path(t.spark, f"bronze-{table}")
        land_json(records, bronze, "2026-02-01")
        tables.append(_silver(t, table, bronze, "json", suffix)[0])
        silver[table] = t.spark.table(tables[-1])
    location = scratch_path(t.spark, "gold")
    target = f"tb_ft_ranking_anual_{suffix}"
    create_table(t.spark, f"gold.{target}", "tb_ft_ranking_anual", location, wide=True)
    silver_to_gold(t.spark, RefineSpec.parse({"target_table": f"gold_{target}"}), lambda: gold.annual_ranking(
        silver["tb_alertas"], silver["tb_municipios"], silver["tb_populacao"]))
    result = t.spark.read.schema(t.spark.table(f"gold.{target}").schema).parquet(location)
    for name in [*tables, f"gold.{target}"]:
        t.spark.sql(f"DROP TABLE {name}")
    narrow = {c: F.col(c).cast("int") for c in ("nr_ano_epi", "nr_max_alerta")}
    return result.withColumns(narrow)


@query("ingest_notifications", """
SELECT id_agravo, dt_notific, CAST(NULL AS DATE) AS dt_sin_pri, id_municip, CAST(sg_uf AS BIGINT) AS sg_uf,
       CAST(nu_idade_n AS BIGINT) AS nu_idade_n, nullif(cs_sexo, '') AS cs_sexo, classi_fin,
       nullif(evolucao, '') AS evolucao FROM v_notificacoes""")
def _(t):
    """Delimited landings whose headers differ between diseases, one of them without a column."""
    suffix = scratch_path(t.spark, "run").rsplit("-", 1)[1]
    t.spark.sql("CREATE DATABASE IF NOT EXISTS silver")
    bronze = scratch_path(t.spark, "bronze-notifications")
    folder = f"{bronze}/ingestion_date=2026-02-01"
    first = F.col("id_agravo") == "A90"
    texts = t.notifications.select(*[F.col(c).cast("string").alias(c.upper()) for c in t.notifications.columns])
    options = {"header": True, "emptyValue": ""}
    texts.filter(first).write.options(**options).csv(folder)
    texts.filter(~first).select(*texts.columns[::-1]).write.mode("append").options(**options).csv(folder)
    name, stored = _silver(t, "tb_notificacoes", bronze, "csv", suffix)
    result = t.spark.table(name)
    back = t.spark.read.schema(result.schema).parquet(stored)
    t.spark.sql(f"DROP TABLE {name}")
    return back

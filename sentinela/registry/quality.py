"""Data-quality suites and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sentinela.config import QualitySpec, parse_schema
from sentinela.operators import reconcile
from sentinela.operators.quality import run_checks, run_suite
from sentinela.plans.defaults import SUITES
from sentinela.registry.base import Tables, query


def _suite(df: DataFrame, checks: dict, table: str = "t") -> DataFrame:
    return run_checks(df, checks, table).select("column_tested", "test_applied", "unexpected_count", "status")


def _expected(*rows: tuple[str, str, str, str]) -> str:
    """One result row per ``(subject, label, unexpected count, table)``; 0 unexpected means success."""
    return " UNION ALL ".join(
        f"SELECT '{subject}' AS column_tested, '{label}' AS test_applied, CAST(n AS BIGINT) AS unexpected_count, "
        f"CASE WHEN n = 0 THEN 'success' ELSE 'failure' END AS status FROM (SELECT {count} AS n FROM {table})"
        for subject, label, count, table in rows)


def _where(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


@query("dq_not_null", _expected(
    ("status", "not null values", _where("status IS NULL"), "v_runs"),
    ("event_id", "not null values", _where("event_id IS NULL"), "v_runs")))
def _(t):
    return _suite(t.runs, {"not_null": {"column": "STATUS,event_id"}}).withColumn(
        "column_tested", F.lower("column_tested"))


@query("dq_unique", " UNION ALL ".join(
    f"SELECT '{c}' AS column_tested, 'unique values' AS test_applied, CAST(coalesce(sum(n), 0) AS BIGINT) "
    f"AS unexpected_count, CASE WHEN count(n) = 0 THEN 'success' ELSE 'failure' END AS status "
    f"FROM (SELECT count(*) AS n FROM orders GROUP BY {c} HAVING count(*) > 1)"
    for c in ("o_orderkey", "o_custkey", "o_totalprice")))
def _(t):
    return _suite(t.orders, {"unique_vals": {"column": "o_orderkey,o_custkey,o_totalprice"}})


@query("dq_date_mask", _expected(
    ("d1", "date mask matches %Y-%m-%d", _where("false"), "orders"),
    ("d2", "date mask matches %d/%m/%Y", _where("day(o_orderdate) > 12 OR o_orderpriority = '1-URGENT'"), "orders")))
def _(t):
    text = t.orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("d1"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "unknown")
        .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("d2"))
    return _suite(text, {"date_mask_equal": {"column": "d1,d2", "date_mask": "%Y-%m-%d,%d/%m/%Y"}})


@query("dq_length_between", _expected(
    ("text", "value length between 50 and 2000", _where("length(text) NOT BETWEEN 50 AND 2000"), "documents"),
    ("lang", "value length between 2 and 2", _where("length(lang) <> 2"), "documents")))
def _(t):
    return _suite(t.documents, {"value_length_between": {"column": "text,lang", "min": "50,2", "max": "2000,2"}})


@query("dq_row_count", """
SELECT 'Dataset' AS column_tested, 'DataFrame row count between 1000 and 500000' AS test_applied,
       CAST(CASE WHEN count(*) BETWEEN 1000 AND 500000 THEN 0 ELSE 1 END AS BIGINT) AS unexpected_count,
       CASE WHEN count(*) BETWEEN 1000 AND 500000 THEN 'success' ELSE 'failure' END AS status FROM orders""")
def _(t):
    return _suite(t.orders, {"df_count_between": {"min": "1000", "max": 500000}})


@query("dq_regex", _expected(
    ("c_name", "values match regex ^Customer#[0-9]{9}$",
     _where("NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')"), "customer"),
    ("c_mktsegment", "values match regex ^(BUILDING|MACHINERY),?$",
     _where("c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"), "customer")))
def _(t):
    return _suite(t.customer, {"value_match_regex": {
        "column": ["c_name", "c_mktsegment"], "regex": ["^Customer#[0-9]{9}$", "^(BUILDING|MACHINERY),?$"]}})


@query("dq_between", """
SELECT 'o_totalprice' AS column_tested, 'values between 1000.0 and 400000.0' AS test_applied,
       count(*) FILTER (WHERE NOT o_totalprice BETWEEN 1000 AND 400000) AS unexpected_count,
       round(avg(o_totalprice) FILTER (WHERE NOT o_totalprice BETWEEN 1000 AND 400000), 4) AS mean_unexpected,
       CASE WHEN bool_and(o_totalprice BETWEEN 1000 AND 400000) THEN 'success' ELSE 'failure' END AS status
FROM orders""")
def _(t):
    checked = run_checks(t.orders, {"values_between": {"column": "o_totalprice", "min": "1000", "max": "400000"}}, "t")
    return checked.select("column_tested", "test_applied", "unexpected_count",
                          F.round("mean_unexpected", 4).alias("mean_unexpected"), "status")


@query("dq_not_in_set", _expected(
    ("o_orderstatus", "column o_orderstatus must not contain values [X, P]",
     _where("o_orderstatus IN ('X', 'P')"), "orders")))
def _(t):
    found = _suite(t.orders, {"values_not_be_in_set": {
        "column": "o_orderstatus", "type": "str", "set_values": [["X", "P"]]}})
    return found.withColumn("test_applied", F.regexp_replace("test_applied", "'", ""))


@query("dq_in_set", _expected(
    ("ds_doenca", "column ds_doenca must only contain values [dengue, chikungunya, zika]", _where("false"),
     "v_alertas"),
    ("nr_nivel_alerta", "column nr_nivel_alerta must only contain values [1, 2, 3]",
     _where("nr_nivel_alerta > 3"), "v_alertas")))
def _(t):
    found = _suite(t.alerts, {"values_to_be_in_set": {
        "column": "ds_doenca,nr_nivel_alerta", "type": "str,int",
        "set_values": [["dengue", "chikungunya", "zika"], ["1", "2", "3"]]}})
    return found.withColumn("test_applied", F.regexp_replace("test_applied", "'", ""))


# Inputs on which every check of the suites meets some rows that violate it; the text runs in both engines.
BAD_ALERTS = """
SELECT CASE WHEN nr_semana_epi = 9 THEN NULL ELSE cd_geocode END AS cd_geocode,
       CASE nr_semana_epi WHEN 10 THEN NULL WHEN 11 THEN 'febre' ELSE ds_doenca END AS ds_doenca,
       CASE WHEN nr_semana_epi = 12 AND vl_casos > 1 THEN NULL WHEN nr_semana_epi = 12 THEN 54 ELSE nr_semana_epi END
           AS nr_semana_epi,
       CASE nr_semana_epi WHEN 13 THEN NULL WHEN 14 THEN 9 ELSE nr_nivel_alerta END AS nr_nivel_alerta,
       CASE nr_semana_epi WHEN 15 THEN NULL WHEN 16 THEN -1 ELSE vl_casos END AS vl_casos,
       CASE WHEN nr_semana_epi = 17 THEN 7 ELSE vl_receptividade END AS vl_receptividade,
       CASE WHEN nr_semana_epi = 18 THEN 5 ELSE vl_transmissao END AS vl_transmissao
FROM {alerts}"""
BAD_PLACES = """
SELECT CASE cd_geocode % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE cd_geocode END AS cd_geocode,
       CASE WHEN cd_geocode % 3 = 0 THEN NULL ELSE nm_municipio END AS nm_municipio
FROM {places}"""
BAD_POPULATION = """
SELECT CASE WHEN cd_geocode % 11 = 0 THEN NULL ELSE cd_geocode END AS cd_geocode,
       CASE WHEN cd_geocode % 4 = 0 THEN NULL ELSE vl_populacao END AS vl_populacao
FROM {population}"""
BAD_NOTIFICATIONS = """
SELECT CASE WHEN sg_uf = 33 THEN NULL ELSE id_agravo END AS id_agravo,
       CASE WHEN nu_idade_n IS NULL THEN NULL ELSE dt_notific END AS dt_notific,
       CASE WHEN id_municip % 10 = 0 THEN NULL ELSE id_municip END AS id_municip
FROM {notifications}"""


@query("dq_suite", f"""
WITH bad AS ({BAD_ALERTS.format(alerts="v_alertas")}), found AS (
SELECT unnest(['cd_geocode', 'ds_doenca', 'nr_semana_epi', 'nr_nivel_alerta', 'vl_casos', 'ds_doenca',
               'nr_nivel_alerta', 'vl_receptividade', 'vl_transmissao', 'nr_semana_epi', 'vl_casos', 'Dataset']) AS c,
       unnest([count(*) FILTER (WHERE cd_geocode IS NULL), count(*) FILTER (WHERE ds_doenca IS NULL),
               count(*) FILTER (WHERE nr_semana_epi IS NULL), count(*) FILTER (WHERE nr_nivel_alerta IS NULL),
               count(*) FILTER (WHERE vl_casos IS NULL), count(*) FILTER (WHERE ds_doenca = 'febre'),
               count(*) FILTER (WHERE nr_nivel_alerta NOT BETWEEN 1 AND 4),
               count(*) FILTER (WHERE vl_receptividade NOT BETWEEN 0 AND 4),
               count(*) FILTER (WHERE vl_transmissao NOT BETWEEN 0 AND 4),
               count(*) FILTER (WHERE nr_semana_epi NOT BETWEEN 1 AND 53), count(*) FILTER (WHERE vl_casos < 0),
               CASE WHEN count(*) NOT BETWEEN 1 AND 200000 THEN 1 ELSE 0 END]) AS n
FROM bad
UNION ALL
SELECT 'cd_geocode', sum(k) FROM (SELECT count(*) AS k FROM bad WHERE cd_geocode IS NOT NULL GROUP BY cd_geocode
                                  HAVING count(*) > 1))
SELECT 'monitor_tb_alertas' AS table_name, c AS column_tested, CAST(n AS BIGINT) AS unexpected_count,
       CASE WHEN n = 0 THEN 'success' ELSE 'failure' END AS status
FROM found""")
def _(t):
    checks = {**SUITES["tb_alertas"], "unique_vals": {"column": "cd_geocode"}}
    found = run_checks(t.spark.sql(BAD_ALERTS, alerts=t.alerts), checks, "monitor_tb_alertas")
    return found.select("table_name", "column_tested", "unexpected_count", "status")


@query("dq_suite_places", f"""
WITH bad AS ({BAD_PLACES.format(places="v_municipios")})
SELECT 'tb_municipios' AS table_name, unnest(['cd_geocode', 'nm_municipio', 'cd_geocode', 'Dataset']) AS column_tested,
       unnest([count(*) FILTER (WHERE cd_geocode IS NULL), count(*) FILTER (WHERE nm_municipio IS NULL),
               (SELECT coalesce(sum(k), 0)::BIGINT FROM (SELECT count(*) AS k FROM bad WHERE cd_geocode IS NOT NULL
                                                         GROUP BY cd_geocode HAVING count(*) > 1)),
               CAST(count(*) NOT BETWEEN 640 AND 660 AS BIGINT)]) AS unexpected_count
FROM bad""")
def _(t):
    found = run_checks(t.spark.sql(BAD_PLACES, places=t.municipalities), SUITES["tb_municipios"], "tb_municipios")
    return found.select("table_name", "column_tested", "unexpected_count")


@query("dq_suite_population", f"""
WITH bad AS ({BAD_POPULATION.format(population="v_populacao")})
SELECT 'tb_populacao' AS table_name, c AS column_tested, CAST(n AS BIGINT) AS unexpected_count
FROM (SELECT unnest(['cd_geocode', 'vl_populacao', 'Dataset', 'vl_populacao']) AS c,
             unnest([count(*) FILTER (WHERE cd_geocode IS NULL), count(*) FILTER (WHERE vl_populacao IS NULL),
                     CAST(count(*) NOT BETWEEN 640 AND 660 AS BIGINT),
                     count(*) FILTER (WHERE vl_populacao NOT BETWEEN 100 AND 15000000)]) AS n FROM bad
      UNION ALL
      SELECT 'cd_geocode', coalesce(sum(k), 0)
      FROM (SELECT count(*) AS k FROM bad WHERE cd_geocode IS NOT NULL GROUP BY cd_geocode HAVING count(*) > 1))""")
def _(t):
    found = run_checks(t.spark.sql(BAD_POPULATION, population=t.population), SUITES["tb_populacao"], "tb_populacao")
    return found.select("table_name", "column_tested", "unexpected_count")


@query("dq_suite_notifications", f"""
WITH bad AS ({BAD_NOTIFICATIONS.format(notifications="v_notificacoes")})
SELECT 'tb_notificacoes' AS table_name, unnest(['id_agravo', 'dt_notific', 'id_municip', 'dataset']) AS column_tested,
       unnest([count(*) FILTER (WHERE id_agravo IS NULL), count(*) FILTER (WHERE dt_notific IS NULL),
               count(*) FILTER (WHERE id_municip IS NULL),
               CAST(count(*) NOT BETWEEN 1000 AND 50000000 AS BIGINT)]) AS unexpected_count
FROM bad""")
def _(t):
    bad = t.spark.sql(BAD_NOTIFICATIONS, notifications=t.notifications)
    found = run_checks(bad, SUITES["tb_notificacoes"], "tb_notificacoes")
    return found.select("table_name", F.lower("column_tested").alias("column_tested"), "unexpected_count")


@query("dq_stop_job", f"""
WITH bad AS ({BAD_PLACES.format(places="v_municipios")})
SELECT unnest(['cd_geocode', 'nm_municipio']) AS column_tested,
       unnest([CASE WHEN count(cd_geocode) < count(*) THEN 'failure' ELSE 'success' END,
               CASE WHEN count(nm_municipio) < count(*) THEN 'failure' ELSE 'success' END]) AS status
FROM bad""")
def _(t):
    """A suite that stops the job hands over the outcomes of all its checks."""
    quality = QualitySpec.parse({"trgt_tbl": "tb_municipios", "stop_job": True, "quality_params": {
        "not_null": {"column": "cd_geocode,nm_municipio"}}})
    try:
        outcomes = run_suite(t.spark.sql(BAD_PLACES, places=t.municipalities), quality)
    except Exception as stop:
        if not hasattr(stop, "outcomes"):
            raise
        outcomes = stop.outcomes
    return t.spark.createDataFrame([(o["column_tested"], o["status"]) for o in outcomes], "column_tested string, status string")


def _perturbed_orders(t: Tables) -> DataFrame:
    """A copy from another system: padded text, one status missing, one priority repriced."""
    return t.orders.filter(F.col("o_orderstatus") != "P").select(
        "o_orderkey", "o_custkey",
        F.concat(F.lit(" ​"), F.col("o_orderstatus"), F.lit("  ")).alias("o_orderstatus"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
        .alias("o_totalprice"),
        "o_orderdate", "o_orderpriority")


@query("recon_counts", """
SELECT count(*) AS left_count, count(*) FILTER (WHERE o_orderstatus <> 'P') AS right_count,
       CASE WHEN bool_and(o_orderstatus <> 'P') THEN 'success' ELSE 'failure' END AS status FROM orders""")
def _(t):
    return reconcile.compare_counts(t.orders, _perturbed_orders(t))


@query("recon_row_diff", """
SELECT count(*) FILTER (WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW') AS only_left,
       count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderpriority = '5-LOW') AS only_right,
       'failure' AS status FROM orders""")
def _(t):
    return reconcile.compare_rows(t.orders, _perturbed_orders(t), parse_schema({
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "decimal(18,2)",
        "o_orderdate": "date", "o_orderpriority": "string"}))


@query("recon_differing_rows", """
SELECT o_orderkey, o_orderpriority, o_orderstatus,
       round(o_totalprice + side, 2) AS o_totalprice, CAST(1 - side AS BIGINT) AS only_left,
       CAST(side AS BIGINT) AS only_right
FROM (SELECT o.*, unnest([0, 1]) AS side FROM orders o)
WHERE CASE side WHEN 0 THEN o_orderstatus = 'P' OR o_orderpriority = '5-LOW'
                ELSE o_orderstatus <> 'P' AND o_orderpriority = '5-LOW' END""")
def _(t):
    keep = ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]
    rows = reconcile.differing_rows(t.orders.select(*keep), _perturbed_orders(t).select(*keep))
    return rows.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("recon_normalized", """
SELECT trim(regexp_replace(trim(text), '[\\x{200B}\\x{00A0}\\x{2000}-\\x{200F}\\x{2028}\\x{2029}\\x{3000}\\x{FEFF}]', '', 'g'))
       AS text, doc_id FROM documents""")
def _(t):
    noisy = t.documents.select("doc_id", F.concat(
        F.lit("\ufeff\u00a0\u3000"), F.regexp_replace(F.trim("text"), " ", " \u200d"), F.lit("\u200b ")).alias("text"))
    return reconcile.normalized(noisy)


@query("recon_metrics", """
WITH pair AS (
SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n2,
       sum(o_orderkey) AS k, sum(o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS k2,
       sum(CAST(o_totalprice AS DECIMAL(18,2))) AS p,
       sum(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END)
           FILTER (WHERE o_orderstatus <> 'P') AS p2,
       min(o_orderdate) AS lo, min(o_orderdate) FILTER (WHERE o_orderstatus <> 'P') AS lo2,
       max(o_orderdate) AS hi, max(o_orderdate) FILTER (WHERE o_orderstatus <> 'P') AS hi2 FROM orders),
long AS (
SELECT 'row_count' AS metric, CAST(n AS VARCHAR) AS left_value, CAST(n2 AS VARCHAR) AS right_value FROM pair
UNION ALL SELECT 'sum_o_orderkey', CAST(k AS VARCHAR), CAST(k2 AS VARCHAR) FROM pair
UNION ALL SELECT 'sum_o_totalprice', CAST(CAST(p AS DECIMAL(38,2)) AS VARCHAR),
                 CAST(CAST(p2 AS DECIMAL(38,2)) AS VARCHAR) FROM pair
UNION ALL SELECT 'min_o_orderdate', strftime(lo, '%Y-%m-%d %H:%M:%S'), strftime(lo2, '%Y-%m-%d %H:%M:%S') FROM pair
UNION ALL SELECT 'max_o_orderdate', strftime(hi, '%Y-%m-%d %H:%M:%S'), strftime(hi2, '%Y-%m-%d %H:%M:%S') FROM pair)
SELECT *, CASE WHEN left_value = right_value THEN 'success' ELSE 'failure' END AS status FROM long""")
def _(t):
    keep = ["o_orderkey", "o_totalprice", "o_orderdate"]
    return reconcile.compare_metrics(t.orders.select(*keep), _perturbed_orders(t).select(*keep))


@query("table_schema", """
SELECT column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                                   WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'string' END AS column_type, n AS rows
FROM (DESCRIBE lineitem) d(column_name, data_type, a, b, c, e), (SELECT count(*) AS n FROM lineitem)""")
def _(t):
    from sentinela.sources.catalog import table_schema

    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(k).alias("column_type"))
                      for n, k in table_schema(t.lineitem)])
    counted = t.lineitem.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.inline(pairs), "rows")

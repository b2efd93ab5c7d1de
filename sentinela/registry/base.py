"""Registration and the input views shared by all queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# The input views. The text runs in both engines; codes and counts are 64-bit, since they grow
# with the tables. Measures are whole numbers of 64ths or 32nds, so that sums of doubles are exact
# and do not depend on the order in which an engine adds them. Where a mean is rounded, the SQL adds
# a billionth, as it would otherwise round some exact halves down.
VIEWS = {
    "v_municipios": """
SELECT CAST(s.s_suppkey*10 + s.s_suppkey%7 AS BIGINT) AS cd_geocode, s.s_name AS nm_municipio,
       n.n_name AS nm_microrregiao, r.r_name AS nm_mesorregiao
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE s.s_suppkey % 20 <> 19""",
    "v_alertas": """
SELECT CAST(l_suppkey*10 + l_suppkey%7 AS BIGINT) AS cd_geocode,
       CASE l_returnflag WHEN 'A' THEN 'dengue' WHEN 'N' THEN 'chikungunya' ELSE 'zika' END AS ds_doenca,
       CAST(date_trunc('week', l_shipdate) AS DATE) AS dt_semana_epidemiologica,
       CAST(year(date_trunc('week', l_shipdate)) AS INT) AS nr_ano_epi,
       CAST(weekofyear(CAST(date_trunc('week', l_shipdate) AS DATE)) AS INT) AS nr_semana_epi,
       CAST(1 + sum(l_linenumber)%4 AS INT) AS nr_nivel_alerta,
       CAST(count(*) AS BIGINT) AS vl_casos,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)/32.0 AS vl_casos_estimados,
       CASE WHEN min(l_partkey)%11 = 0 THEN NULL
            ELSE CAST(floor(CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE)/CAST(count(*) AS DOUBLE)*64/5.0)
                 AS DOUBLE)/64.0 END AS vl_rt,
       CAST(count(*) AS DOUBLE)*2.5 AS vl_incidencia,
       CAST(sum(l_linenumber)%2 AS INT) AS vl_transmissao,
       CAST(min(l_linenumber)%2 AS INT) AS vl_receptividade,
       CAST(12 + l_suppkey%10 AS DOUBLE) AS vl_temp_min, CAST(25 + l_suppkey%8 AS DOUBLE) AS vl_temp_max,
       CAST(40 + l_suppkey%30 AS DOUBLE) AS vl_umid_min, CAST(75 + l_suppkey%25 AS DOUBLE) AS vl_umid_max
FROM lineitem GROUP BY l_suppkey, l_returnflag, date_trunc('week', l_shipdate)""",
    "v_populacao": """
SELECT CAST(l_suppkey*10 + l_suppkey%7 AS BIGINT) AS cd_geocode, CAST(year(l_shipdate) AS INT) AS dt_ano_referencia,
       CAST(CASE WHEN l_suppkey%25 = 3 THEN 0 ELSE sum(CAST(l_quantity AS BIGINT))*(l_suppkey%60) END AS BIGINT)
           AS vl_populacao
FROM lineitem WHERE l_suppkey%10 <> 9 GROUP BY l_suppkey, year(l_shipdate)""",
    "v_notificacoes": """
SELECT CASE o_orderstatus WHEN 'F' THEN 'A90' WHEN 'O' THEN 'A92' ELSE 'A92.8' END AS id_agravo,
       CAST(o_orderdate AS DATE) AS dt_notific, CAST(o_custkey%110 AS BIGINT) AS id_municip,
       CAST(CASE WHEN o_orderkey%5 = 4 THEN 33 ELSE 35 END AS INT) AS sg_uf,
       CASE WHEN o_orderkey%97 = 0 THEN NULL ELSE CAST(o_orderkey*37%36525 AS INT) END AS nu_idade_n,
       CASE o_custkey%4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN '' ELSE NULL END AS cs_sexo,
       CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN '10' ELSE '0' END AS classi_fin,
       CASE o_orderpriority WHEN '1-URGENT' THEN '3' WHEN '2-HIGH' THEN '1' WHEN '3-MEDIUM' THEN '9'
                            WHEN '5-LOW' THEN '1' ELSE '' END AS evolucao
FROM orders""",
    "v_runs": """
SELECT event_id, date_trunc('hour', ts) AS start_execution, ts AS end_execution,
       concat('job_', CAST(user_id%7 AS STRING)) AS job_name, concat('tb_', CAST(user_id%4 AS STRING)) AS table_name,
       CASE user_id%4 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' WHEN 2 THEN 'gold' ELSE 'quality' END AS layer,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' WHEN 'view' THEN NULL
                       ELSE 'success' END AS status,
       CASE WHEN event_type = 'signup' THEN 'slow source' END AS warning_description,
       user_id%5 = 0 AS critical_table, props AS info, CAST(ts AS DATE) AS dt_ref
FROM events""",
}

# The same views written for the checking side only.
CHECK_VIEWS = {
    "v_dq_tests": """
SELECT r.event_id, r.start_execution, r.table_name, r.job_name, concat('col_', CAST(t.k AS STRING)) AS column_tested,
       CASE t.k WHEN 1 THEN 'not null values' WHEN 2 THEN 'unique values' ELSE 'values between' END AS test_applied,
       CASE WHEN (r.event_id + t.k) % 5 = 0 THEN 'failure' ELSE 'success' END AS status
FROM v_runs r, (VALUES (1),(2),(3)) AS t(k) WHERE r.layer = 'quality'""",
    "g_pop": """
SELECT cd_geocode, arg_max(vl_populacao, dt_ano_referencia) AS vl_populacao FROM v_populacao GROUP BY cd_geocode""",
    "g_weekly": """
SELECT a.cd_geocode, nm_municipio, nm_microrregiao, nm_mesorregiao, vl_populacao, nr_semana_epi, nr_nivel_alerta,
       coalesce(list_extract(['verde','amarelo','laranja','vermelho'], nr_nivel_alerta), 'desconhecido')
           AS ds_nivel_alerta,
       vl_casos, vl_casos_estimados, vl_incidencia, vl_rt,
       CAST(coalesce(vl_rt > 1 AND vl_transmissao = 1, false) AS INT) AS fl_epidemia,
       vl_transmissao AS fl_transmissao, vl_receptividade AS fl_receptividade,
       vl_temp_min, vl_temp_max, vl_umid_min, vl_umid_max, nr_ano_epi, ds_doenca, dt_semana_epidemiologica
FROM v_alertas a LEFT JOIN v_municipios m USING (cd_geocode) LEFT JOIN g_pop p USING (cd_geocode)""",
    "g_burden": """
SELECT w.cd_geocode, nm_municipio, nm_microrregiao, nm_mesorregiao, any_value(vl_populacao) AS vl_populacao,
       CAST(sum(vl_casos) AS BIGINT) AS vl_total_casos, max(nr_nivel_alerta) AS nr_max_alerta,
       count(*) FILTER (WHERE nr_nivel_alerta = 4) AS nr_semanas_alerta_vermelho,
       count(*) FILTER (WHERE nr_nivel_alerta >= 3) AS nr_semanas_alerta_alto,
       count(*) FILTER (WHERE fl_transmissao = 1) AS nr_semanas_transmissao_ativa,
       count(*) FILTER (WHERE vl_rt > 1) AS nr_semanas_rt_acima_1,
       round(avg(vl_rt) + 1e-9, 4) AS vl_rt_medio,
       nr_ano_epi, ds_doenca
FROM g_weekly w GROUP BY w.cd_geocode, nm_municipio, nm_microrregiao, nm_mesorregiao, nr_ano_epi, ds_doenca""",
    "g_rate": """
SELECT b.*, CAST(vl_total_casos AS DOUBLE) * 100000.0 / nullif(vl_populacao, 0) AS taxa FROM g_burden b""",
    "g_ranking": """
SELECT cd_geocode, nm_municipio, nm_microrregiao, nm_mesorregiao, vl_populacao, vl_total_casos,
       round(taxa, 2) AS vl_incidencia_acumulada, nr_max_alerta, nr_semanas_alerta_vermelho, nr_semanas_alerta_alto,
       nr_semanas_transmissao_ativa, nr_semanas_rt_acima_1, vl_rt_medio,
       rank() OVER (estado ORDER BY taxa DESC NULLS LAST) AS nr_rank_estado,
       rank() OVER (PARTITION BY nr_ano_epi, ds_doenca, nm_mesorregiao ORDER BY taxa DESC NULLS LAST)
           AS nr_rank_mesorregiao,
       nr_ano_epi, ds_doenca
FROM g_rate WINDOW estado AS (PARTITION BY nr_ano_epi, ds_doenca)""",
    "g_year": """
SELECT cd_geocode, nm_municipio, nm_microrregiao, nm_mesorregiao, ds_doenca, nr_ano_epi,
       CAST(coalesce(vl_populacao, 0) AS DOUBLE) AS vl_populacao,
       CAST(vl_total_casos AS DOUBLE) AS vl_total_casos,
       coalesce(round(taxa, 2), 0.0) AS vl_incidencia_acumulada,
       CAST(nr_semanas_alerta_alto AS DOUBLE) AS nr_semanas_alerta_alto,
       CAST(nr_semanas_rt_acima_1 AS DOUBLE) AS nr_semanas_rt_acima_1, coalesce(vl_rt_medio, 0.0) AS vl_rt_medio
FROM g_rate WHERE ds_doenca = 'dengue' AND nr_ano_epi = 1998""",
    "g_tops": """
SELECT greatest(max(nr_semanas_rt_acima_1), 11.0) AS weeks, max(vl_incidencia_acumulada) AS incidence FROM g_year""",
    "g_scored": """
SELECT y.*, vl_rt_medio * least(nr_semanas_rt_acima_1 / weeks, 1.0) AS vl_rt_ajustado,
       CASE WHEN vl_populacao < 5000 THEN 0.0
            ELSE vl_rt_medio * least(nr_semanas_rt_acima_1 / weeks, 1.0) * 0.5
                 + coalesce(vl_incidencia_acumulada / nullif(incidence, 0.0), 0.0) * 0.5 END AS vl_prioridade
FROM g_year y, g_tops""",
    "g_profile": """
SELECT n.id_municip AS cd_geocode_ibge, nm_municipio, nm_microrregiao, nm_mesorregiao, id_agravo,
       coalesce(map_extract_value(MAP {'A90': 'dengue', 'A92': 'chikungunya', 'A92.8': 'zika'}, id_agravo), id_agravo)
           AS ds_doenca,
       CASE WHEN nu_idade_n IS NULL OR floor(nu_idade_n / 365.25) >= 60 THEN '60+'
            WHEN floor(nu_idade_n / 365.25) >= 30 THEN '30-59' WHEN floor(nu_idade_n / 365.25) >= 15 THEN '15-29'
            WHEN floor(nu_idade_n / 365.25) >= 5 THEN '5-14' ELSE '0-4' END AS ds_faixa_etaria,
       CASE WHEN cs_sexo IS NULL OR cs_sexo = '' THEN 'I' ELSE cs_sexo END AS cs_sexo,
       count(*) AS nr_notificacoes, count(*) FILTER (WHERE classi_fin = '10') AS nr_casos_confirmados,
       count(*) FILTER (WHERE evolucao IN ('3', '9')) AS nr_obitos, count(*) FILTER (WHERE evolucao = '1') AS nr_curas,
       CAST(year(dt_notific) AS INT) AS nr_ano_notificacao, CAST(month(dt_notific) AS INT) AS nr_mes_notificacao
FROM v_notificacoes n LEFT JOIN v_municipios m ON n.id_municip = m.cd_geocode // 10
WHERE sg_uf = 35
GROUP BY ALL""",
    "g_demo": """
SELECT * FROM g_profile WHERE ds_doenca = 'dengue' AND nr_ano_notificacao = 1998""",
    "g_latest": """
SELECT * FROM g_weekly WHERE ds_doenca = 'dengue' AND dt_semana_epidemiologica =
    (SELECT max(dt_semana_epidemiologica) FROM v_alertas WHERE ds_doenca = 'dengue')""",
    "g_comparative": """
SELECT ds_doenca, nr_nivel_alerta, count(*) AS count_municipalities FROM g_weekly
WHERE dt_semana_epidemiologica = (SELECT max(dt_semana_epidemiologica) FROM v_alertas)
GROUP BY ds_doenca, nr_nivel_alerta""",
    "g_meso": """
SELECT nm_mesorregiao, CAST(sum(vl_casos) AS BIGINT) AS total_cases,
       coalesce(avg(vl_rt), 0.0) AS avg_rt,
       max(nr_nivel_alerta) AS max_alert_level,
       count(*) FILTER (WHERE nr_nivel_alerta >= 3) AS municipalities_high_alert,
       count(DISTINCT cd_geocode) AS total_municipalities,
       count(*) FILTER (WHERE fl_epidemia = 1) AS municipalities_epidemic
FROM g_latest GROUP BY nm_mesorregiao""",
    "g_series": """
SELECT dt_semana_epidemiologica AS week_date, nr_semana_epi AS week_num, CAST(sum(vl_casos) AS BIGINT) AS total_cases,
       sum(vl_casos_estimados) AS estimated_cases,
       coalesce(avg(vl_rt), 0.0) AS avg_rt,
       count(*) FILTER (WHERE nr_nivel_alerta = 1) AS green_count,
       count(*) FILTER (WHERE nr_nivel_alerta = 2) AS yellow_count,
       count(*) FILTER (WHERE nr_nivel_alerta = 3) AS orange_count,
       count(*) FILTER (WHERE nr_nivel_alerta = 4) AS red_count,
       count(DISTINCT cd_geocode) AS municipalities
FROM g_weekly WHERE ds_doenca = 'dengue' AND nr_ano_epi = 1998 GROUP BY week_date, week_num""",
}

_ALL = {**VIEWS, **CHECK_VIEWS}


def _needed(sql: str) -> list[str]:
    """View names a text uses, those they depend on first."""
    found: list[str] = []
    for name in _ALL:
        if re.search(rf"\b{name}\b", sql):
            for inner in [*_needed(_ALL[name]), name]:
                if inner not in found:
                    found.append(inner)
    return found


def with_views(sql: str) -> str:
    """Put the views a check uses in front of it."""
    sql = sql.strip()
    ctes = ", ".join(f"{name} AS ({_ALL[name].strip()})" for name in _needed(sql))
    if not ctes:
        return sql
    if sql[:5].upper() == "WITH ":
        return f"WITH {ctes}, {sql[5:]}"
    return f"WITH {ctes} {sql}"


class Tables:
    """The given tables, and the views derived from them, of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BASE_TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = [t for t in BASE_TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
        for table in used:
            text = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)
        return self.spark.sql(text, **{t: getattr(self, t) for t in used})

    @cached_property
    def municipalities(self) -> DataFrame:
        return self._view("v_municipios")

    @cached_property
    def alerts(self) -> DataFrame:
        return self._view("v_alertas")

    @cached_property
    def population(self) -> DataFrame:
        return self._view("v_populacao")

    @cached_property
    def notifications(self) -> DataFrame:
        return self._view("v_notificacoes")

    @cached_property
    def runs(self) -> DataFrame:
        """Run records; truncating gives a zoned timestamp in Spark, while the given ones have no zone."""
        return self._view("v_runs").withColumn("start_execution", F.col("start_execution").cast("timestamp_ntz"))

    @cached_property
    def dq_tests(self) -> DataFrame:
        """Three tests of every run of the quality layer."""
        names = ["not null values", "unique values", "values between"]
        listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("name")) for k, n in enumerate(names, 1)])
        return (
            self.runs.filter(F.col("layer") == "quality").withColumn("t", F.explode(listed))
            .select("event_id", "start_execution", "table_name", "job_name",
                    F.concat(F.lit("col_"), F.col("t.k").cast("string")).alias("column_tested"),
                    F.col("t.name").alias("test_applied"),
                    F.when((F.col("event_id") + F.col("t.k")) % 5 == 0, "failure").otherwise("success").alias("status"))
        )


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its checking SQL."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle:
            ORACLES[name] = with_views(oracle)
        return fn
    return register

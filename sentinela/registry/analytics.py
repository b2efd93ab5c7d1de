"""Ranking, demographic and generic analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sentinela.functions.dates import look_back
from sentinela.functions.labels import rt_status, size_class
from sentinela.operators import aggregates
from sentinela.operators.filters import search_text
from sentinela.operators.ordering import exact_percentiles
from sentinela.plans import demographics, gold, ranking
from sentinela.registry.base import Tables, query
from sentinela.registry.gold import DISEASE, YEAR
from sentinela.staging import stage


def burden(t: Tables) -> DataFrame:
    """The ranking table's figures; the reports below do not use its two rank columns."""
    return gold.with_incidence(gold.annual_burden(t.alerts, t.municipalities, t.population))


def year(t: Tables) -> DataFrame:
    """One disease and year, staged because the scores read it several times."""
    columns = ["cd_geocode", *gold.NAMES, "ds_doenca", "nr_ano_epi", "vl_populacao", "vl_total_casos",
               "vl_incidencia_acumulada", "nr_semanas_alerta_alto", "nr_semanas_rt_acima_1", "vl_rt_medio"]
    return stage(ranking.yearly(burden(t), DISEASE, YEAR).select(*columns), "ranking-year")


def profile(t: Tables) -> DataFrame:
    return demographics.yearly(gold.demographic_profile(t.notifications, t.municipalities), DISEASE, YEAR)


SCORED = ["cd_geocode", "nm_municipio", "vl_populacao", "vl_incidencia_acumulada", "vl_rt_ajustado", "vl_prioridade"]
SCORED_SQL = ", ".join(SCORED)


@query("priority_score", f"SELECT {SCORED_SQL} FROM g_scored")
def _(t):
    return ranking.with_priority(year(t)).select(*SCORED)


@query("top_n_priority", f"SELECT {SCORED_SQL} FROM g_scored ORDER BY vl_prioridade DESC, cd_geocode LIMIT 20")
def _(t):
    return ranking.top_priority(ranking.with_priority(year(t)), 20).select(*SCORED)


@query("critical_municipalities", f"""
SELECT {SCORED_SQL} FROM g_scored
WHERE vl_rt_ajustado > 0.2
  AND vl_incidencia_acumulada > (SELECT quantile_cont(vl_incidencia_acumulada, 0.9) FROM g_year)""")
def _(t):
    return ranking.critical_municipalities(ranking.with_priority(year(t))).select(*SCORED)


@query("critical_threshold", """
SELECT round(0.1 + coalesce(quantile_cont(vl_incidencia_acumulada, 0.9) / nullif(max(vl_incidencia_acumulada), 0), 0)
             * 0.5, 9) AS limiar_critico FROM g_year""")
def _(t):
    return ranking.critical_threshold(year(t)).select(F.round("limiar_critico", 9).alias("limiar_critico"))


@query("priority_by_region", """
SELECT nm_mesorregiao, nm_municipio, round(sum(vl_prioridade), 6) AS vl_prioridade
FROM g_scored WHERE nm_mesorregiao IS NOT NULL AND nm_municipio IS NOT NULL GROUP BY ALL""")
def _(t):
    found = ranking.priority_by_region(ranking.with_priority(year(t)))
    return found.withColumn("vl_prioridade", F.round("vl_prioridade", 6))


@query("ranking_by_mesoregion", """
SELECT *, CASE WHEN rt_medio > 1.2 THEN 'Crescendo' WHEN rt_medio >= 1 THEN 'Atenção' ELSE 'Controlado' END
    AS situacao_rt
FROM (SELECT nm_mesorregiao, sum(vl_total_casos) AS total_casos, sum(nr_semanas_alerta_alto) AS semanas_alerta_alto,
             round(avg(vl_rt_medio), 8) AS rt_medio,
             count(nm_municipio) AS municipios
      FROM g_year WHERE nm_mesorregiao IS NOT NULL GROUP BY nm_mesorregiao)""")
def _(t):
    return ranking.by_mesoregion(year(t)).withColumn("rt_medio", F.round("rt_medio", 8))


@query("mesoregion_median", """
SELECT median(total) AS mediana FROM (SELECT sum(vl_total_casos) AS total FROM g_year
                                      WHERE nm_mesorregiao IS NOT NULL GROUP BY nm_mesorregiao)""")
def _(t):
    return ranking.mesoregion_median(ranking.by_mesoregion(year(t)))


@query("risk_template", """
WITH places AS (SELECT *, coalesce(round(taxa, 2), NULL) AS inc,
                       vl_rt_medio * least(nr_semanas_rt_acima_1 / 11.0, 1.0) AS adj
                FROM g_rate WHERE nr_ano_epi = 1998 AND ds_doenca = 'dengue' AND vl_populacao >= 5000),
hot AS (SELECT * FROM places WHERE adj > 0.2 AND inc > (SELECT quantile_disc(inc, 0.9) FROM places))
SELECT cd_geocode, nm_municipio, nm_mesorregiao, vl_populacao AS populacao, vl_rt_medio,
       CAST(nr_semanas_rt_acima_1 AS INT) AS semanas_rt_acima_1, inc AS vl_incidencia_acumulada, adj AS rt_ajustado,
       adj * 0.5 + inc / max(inc) OVER () * 0.5 AS pontuacao_risco
FROM hot ORDER BY pontuacao_risco DESC, cd_geocode LIMIT 20""")
def _(t):
    chosen = burden(t).filter((F.col("ds_doenca") == DISEASE) & (F.col("nr_ano_epi") == YEAR))
    return ranking.risk_template(stage(chosen, "ranking"), "Dengue", YEAR)


@query("size_class", """
SELECT cd_geocode, vl_populacao,
       CASE WHEN coalesce(vl_populacao, 0) >= 100000 THEN 'Grande' WHEN vl_populacao >= 20000 THEN 'Médio'
            ELSE 'Pequeno' END AS porte
FROM v_municipios LEFT JOIN g_pop USING (cd_geocode)""")
def _(t):
    places = t.municipalities.join(gold.latest_population(t.population), "cd_geocode", "left")
    return places.select("cd_geocode", "vl_populacao",
                         size_class(F.coalesce("vl_populacao", F.lit(0))).alias("porte"))


@query("rt_status", """
SELECT cd_geocode, ds_doenca, dt_semana_epidemiologica, vl_rt,
       CASE WHEN coalesce(vl_rt, 0) > 1.2 THEN 'Crescendo' WHEN coalesce(vl_rt, 0) < 1 THEN 'Controlado'
            ELSE 'Atenção' END AS situacao
FROM v_alertas""")
def _(t):
    return t.alerts.select("cd_geocode", "ds_doenca", "dt_semana_epidemiologica", "vl_rt",
                           rt_status(F.coalesce("vl_rt", F.lit(0.0))).alias("situacao"))


@query("search_name", "SELECT cd_geocode, nm_municipio FROM v_municipios WHERE regexp_matches(nm_municipio, '(?i)ER#0000.*1')")
def _(t):
    return search_text(t.municipalities, "nm_municipio", "ER#0000.*1", regex=True).select("cd_geocode", "nm_municipio")


@query("search_name_plain", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')")
def _(t):
    return search_text(t.part, "p_name", "RED").select("p_partkey", "p_name")


@query("demographic_rates", """
SELECT CAST(n AS BIGINT) AS notificacoes, CAST(c AS BIGINT) AS confirmados, CAST(d AS BIGINT) AS obitos,
       CAST(h AS BIGINT) AS curas,
       round(CAST(d AS DOUBLE) / c * 100, 2) AS letalidade, round(CAST(h AS DOUBLE) / c * 100, 2) AS cura,
       round(CAST(c AS DOUBLE) / n * 100, 2) AS confirmacao
FROM (SELECT sum(nr_notificacoes) AS n, sum(nr_casos_confirmados) AS c, sum(nr_obitos) AS d, sum(nr_curas) AS h
      FROM g_demo)""")
def _(t):
    return demographics.rates(profile(t))


@query("age_pyramid", """
SELECT ds_faixa_etaria, cs_sexo,
       CAST(sum(nr_notificacoes) * (CASE cs_sexo WHEN 'M' THEN -1 ELSE 1 END) AS BIGINT) AS nr_notificacoes
FROM g_demo WHERE cs_sexo <> 'I' GROUP BY ds_faixa_etaria, cs_sexo""")
def _(t):
    return demographics.age_pyramid(profile(t))


@query("outcome_by_age", """
SELECT ds_faixa_etaria, CAST(sum(nr_curas) AS BIGINT) AS curas, CAST(sum(nr_obitos) AS BIGINT) AS obitos,
       CAST(greatest(sum(nr_notificacoes - nr_curas - nr_obitos), 0) AS BIGINT) AS outros
FROM g_demo GROUP BY ds_faixa_etaria""")
def _(t):
    return demographics.outcome_by_age(profile(t))


@query("sex_age_counts", """
SELECT ds_faixa_etaria, CASE cs_sexo WHEN 'M' THEN 'Masculino' ELSE 'Feminino' END AS cs_sexo,
       CAST(sum(nr_notificacoes) AS BIGINT) AS nr_notificacoes
FROM g_demo WHERE cs_sexo IN ('M', 'F') GROUP BY ALL""")
def _(t):
    return demographics.sex_age_counts(profile(t))


_MONTHS = ["Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez"]


@query("seasonality_pivot", "SELECT nm_mesorregiao, " + ", ".join(
    f"CAST(coalesce(sum(nr_notificacoes) FILTER (WHERE nr_mes_notificacao = {i}), 0) AS BIGINT) AS {m}"
    for i, m in enumerate(_MONTHS, 1)) + " FROM g_demo WHERE nm_mesorregiao IS NOT NULL GROUP BY nm_mesorregiao")
def _(t):
    return demographics.seasonality(profile(t))


@query("kpis_config", """
SELECT count(*) AS total, round(sum(l_extendedprice), 2) AS receita,
       round(avg(l_discount), 8) AS desconto_medio, max(l_quantity) AS maior,
       min(l_quantity) AS menor, count(DISTINCT l_suppkey) AS fornecedores, 0 AS ausente,
       CAST(NULL AS DOUBLE) AS desconhecida
FROM lineitem""")
def _(t):
    figures = aggregates.kpis(t.lineitem, {
        "total": {"operation": "count"},
        "r": {"operation": "sum", "column": "l_extendedprice", "label": "receita"},
        "d": {"operation": "avg", "column": "l_discount", "label": "desconto_medio"},
        "maior": {"operation": "max", "column": "l_quantity"},
        "menor": {"operation": "min", "column": "l_quantity"},
        "fornecedores": {"operation": "unique", "column": "l_suppkey"},
        "ausente": {"operation": "sum", "column": "no_such_column"},
        "desconhecida": {"operation": "mode", "column": "l_quantity"},
    })
    return figures.withColumns({"receita": F.round("receita", 2), "desconto_medio": F.round("desconto_medio", 8)})


@query("group_by_agg", """
SELECT c_nationkey, c_mktsegment, round(sum(c_acctbal), 2) AS sum
FROM customer GROUP BY ALL ORDER BY sum DESC, c_nationkey, c_mktsegment LIMIT 15""")
def _(t):
    grouped = aggregates.group_aggregate(t.customer, ["c_nationkey", "c_mktsegment"], "sum", "c_acctbal", limit=15)
    return grouped.withColumn("sum", F.round("sum", 2))


@query("time_series_day", """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders),
spine AS (SELECT CAST(unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM d)
SELECT s.day AS o_orderdate, count(d.day) AS count FROM spine s LEFT JOIN d ON d.day = s.day GROUP BY s.day""")
def _(t):
    return aggregates.time_series(t.orders, "o_orderdate", "D")


@query("time_series_week", """
WITH d AS (SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS w, value FROM events),
spine AS (SELECT CAST(unnest(range(min(w), max(w) + INTERVAL 1 DAY, INTERVAL 7 DAY)) AS DATE) AS w FROM d)
SELECT s.w AS ts, round(coalesce(sum(value), 0), 6) AS sum
FROM spine s LEFT JOIN d ON d.w = s.w GROUP BY s.w""")
def _(t):
    found = aggregates.time_series(t.events, "ts", "W", "sum", "value")
    return found.withColumn("sum", F.round("sum", 6))


@query("time_series_month", """
WITH d AS (SELECT last_day(o_orderdate) AS m, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'),
spine AS (SELECT last_day(unnest(range(date_trunc('month', min(m)), max(m) + INTERVAL 1 DAY, INTERVAL 1 MONTH))) AS m
          FROM d)
SELECT s.m AS o_orderdate, max(o_totalprice) AS max FROM spine s LEFT JOIN d ON d.m = s.m GROUP BY s.m""")
def _(t):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    return aggregates.time_series(urgent, "o_orderdate", "M", "max", "o_totalprice")


@query("percentiles", """
SELECT round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
       round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95
FROM lineitem""")
def _(t):
    found = exact_percentiles(t.lineitem, "l_extendedprice", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("approx_percentile", """
SELECT quantile_disc(l_quantity, 0.25) AS p25, quantile_disc(l_quantity, 0.75) AS p75,
       quantile_disc(l_quantity, 0.95) AS p95 FROM lineitem""")
def _(t):
    return aggregates.percentiles_approx(t.lineitem, "l_quantity", {"p25": 0.25, "p75": 0.75, "p95": 0.95})


@query("epi_week_range", """
SELECT DISTINCT CAST(ts AS DATE) AS as_of, CAST(isoyear(ts) AS INT) AS year_end, CAST(week(ts) AS INT) AS week_end,
       CAST(isoyear(ts - INTERVAL 28 DAY) AS INT) AS year_start, CAST(week(ts - INTERVAL 28 DAY) AS INT) AS week_start
FROM events""")
def _(t):
    days = t.events.select(F.col("ts").cast("date").alias("as_of")).distinct()
    return days.withColumns(look_back(F.col("as_of")))

"""Gold models and the reports on weekly alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sentinela.operators.ordering import latest_per_key
from sentinela.plans import alerts as reports, gold
from sentinela.registry.base import Tables, query
from sentinela.sources.catalog import run_sql_model

DISEASE, YEAR = "dengue", 1998


def weekly(t: Tables) -> DataFrame:
    return gold.weekly_alerts(t.alerts, t.municipalities, t.population)


@query("latest_per_key", "SELECT cd_geocode, vl_populacao FROM g_pop")
def _(t):
    return latest_per_key(t.population, ["cd_geocode"], ["dt_ano_referencia"], ["vl_populacao"])


@query("gold_weekly_alert", "SELECT * FROM g_weekly")
def _(t):
    return weekly(t)


@query("annual_base", "SELECT * FROM g_burden")
def _(t):
    return gold.annual_burden(t.alerts, t.municipalities, t.population)


@query("gold_annual_ranking", "SELECT * FROM g_ranking")
def _(t):
    return gold.annual_ranking(t.alerts, t.municipalities, t.population)


@query("gold_demographic_profile", "SELECT * FROM g_profile")
def _(t):
    return gold.demographic_profile(t.notifications, t.municipalities)


@query("sql_model", """
SELECT nm_mesorregiao, count(*) AS municipalities, CAST(sum(vl_populacao) AS BIGINT) AS population
FROM v_municipios LEFT JOIN g_pop USING (cd_geocode) WHERE coalesce(vl_populacao, 0) >= 5000 GROUP BY nm_mesorregiao""")
def _(t):
    text = """
        SELECT m.nm_mesorregiao, count(*) AS municipalities, sum(p.vl_populacao) AS population
        FROM {places} m JOIN {people} p ON m.cd_geocode = p.cd_geocode
        WHERE p.vl_populacao >= :smallest GROUP BY m.nm_mesorregiao"""
    return run_sql_model(t.spark, text, {"smallest": 5000}, places=t.municipalities,
                         people=gold.latest_population(t.population))


@query("current_alerts", """
SELECT cd_geocode, nm_municipio, nm_microrregiao, nm_mesorregiao, vl_populacao, nr_semana_epi, nr_nivel_alerta,
       ds_nivel_alerta, vl_casos, vl_incidencia, vl_rt, fl_epidemia, fl_transmissao, fl_receptividade, vl_temp_min,
       vl_temp_max, nr_ano_epi, ds_doenca, dt_semana_epidemiologica FROM g_latest""")
def _(t):
    return reports.current_alerts(weekly(t), DISEASE)


@query("comparative_alerts", "SELECT * FROM g_comparative")
def _(t):
    return reports.comparative_alerts(weekly(t))


@query("mesoregion_summary", "SELECT * FROM g_meso")
def _(t):
    return reports.mesoregion_summary(weekly(t), DISEASE)


@query("kpi_trends", """
SELECT dt_semana_epidemiologica, CAST(sum(vl_casos) AS BIGINT) AS total_cases,
       coalesce(avg(vl_rt), 0.0) AS avg_rt,
       count(*) FILTER (WHERE fl_epidemia = 1) AS municipalities_epidemic,
       CAST(count(*) FILTER (WHERE nr_nivel_alerta = 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS pct_green
FROM g_weekly WHERE ds_doenca = 'dengue' GROUP BY dt_semana_epidemiologica
ORDER BY dt_semana_epidemiologica DESC LIMIT 8""")
def _(t):
    return reports.kpi_trends(weekly(t), DISEASE)


@query("overview_kpis", """
SELECT CAST(sum(vl_casos) AS BIGINT) AS total_cases, count(*) AS total_municipalities,
       round(avg(vl_rt) + 1e-9, 2) AS avg_rt,
       count(*) FILTER (WHERE fl_epidemia = 1) AS municipalities_in_epidemic,
       CAST(count(*) FILTER (WHERE nr_nivel_alerta = 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS pct_green,
       CASE WHEN count(*) FILTER (WHERE nr_nivel_alerta = 1) * 10 > count(*) * 9 THEN 'Controlado' ELSE 'Atenção' END
           AS status
FROM g_latest""")
def _(t):
    return reports.overview_kpis(weekly(t), DISEASE)


@query("disease_total_max", """
SELECT CAST(max(total) AS BIGINT) AS total_mun_max
FROM (SELECT sum(count_municipalities) AS total FROM g_comparative GROUP BY ds_doenca)""")
def _(t):
    return reports.disease_total_max(reports.comparative_alerts(weekly(t)))


@query("active_alert_counts", """
SELECT ds_doenca, CAST(sum(count_municipalities) AS BIGINT) AS active_municipalities
FROM g_comparative WHERE nr_nivel_alerta IS DISTINCT FROM 1 GROUP BY ds_doenca""")
def _(t):
    return reports.active_alert_counts(reports.comparative_alerts(weekly(t)))


@query("alert_level_counts", """
SELECT nr_nivel_alerta, count(*) AS count, list_extract(['Verde','Amarelo','Laranja','Vermelho'], nr_nivel_alerta)
    AS label FROM g_latest GROUP BY nr_nivel_alerta""")
def _(t):
    return reports.alert_level_counts(reports.latest_week(weekly(t), DISEASE))


@query("top_mesoregions", """
SELECT *, list_extract(['Verde','Amarelo','Laranja','Vermelho'], max_alert_level) AS nivel_label
FROM g_meso ORDER BY total_cases DESC, nm_mesorregiao NULLS LAST LIMIT 10""")
def _(t):
    return reports.top_mesoregions(reports.mesoregion_summary(weekly(t), DISEASE))


@query("weekly_series", "SELECT * FROM g_series")
def _(t):
    return reports.weekly_series(weekly(t), DISEASE, YEAR)


@query("weekly_series_display", """
SELECT strftime(week_date, '%d/%m/%Y') AS data, week_num AS semana, total_cases AS casos,
       estimated_cases AS estimados, avg_rt AS rt_medio, municipalities AS municipios FROM g_series""")
def _(t):
    return reports.weekly_series_display(reports.weekly_series(weekly(t), DISEASE, YEAR))


@query("alert_levels_long", """
SELECT week_date, 'Verde' AS nivel, green_count AS alertas FROM g_series
UNION ALL SELECT week_date, 'Amarelo', yellow_count FROM g_series
UNION ALL SELECT week_date, 'Laranja', orange_count FROM g_series
UNION ALL SELECT week_date, 'Vermelho', red_count FROM g_series""")
def _(t):
    return reports.alert_levels_long(reports.weekly_series(weekly(t), DISEASE, YEAR))


@query("latest_week_number", """
SELECT * FROM g_weekly WHERE ds_doenca = 'dengue' AND nr_ano_epi = 1998
QUALIFY nr_semana_epi = max(nr_semana_epi) OVER ()""")
def _(t):
    return reports.latest_week_number(weekly(t), "Dengue", YEAR)


@query("available_years", "SELECT DISTINCT nr_ano_epi FROM v_alertas WHERE ds_doenca = 'dengue'")
def _(t):
    return reports.available_years(weekly(t), DISEASE)


@query("critical_last_week", """
SELECT cd_geocode, nm_municipio, ds_doenca, vl_incidencia, nr_nivel_alerta
FROM v_alertas JOIN v_municipios USING (cd_geocode)
WHERE nr_nivel_alerta = 4 AND dt_semana_epidemiologica = (SELECT max(dt_semana_epidemiologica) FROM v_alertas)""")
def _(t):
    return reports.critical_last_week(t.alerts, t.municipalities)


@query("history_12_weeks", """
SELECT dt_semana_epidemiologica AS semana, nm_municipio,
       sum(vl_casos_estimados) AS total_casos,
       sum(vl_incidencia) / count(vl_incidencia) AS incidencia_media
FROM v_alertas JOIN v_municipios USING (cd_geocode)
WHERE ds_doenca = 'dengue' AND dt_semana_epidemiologica >= DATE '2001-08-01' - INTERVAL 84 DAY
GROUP BY semana, nm_municipio""")
def _(t):
    return reports.history_weeks(t.alerts, t.municipalities, DISEASE, as_of="2001-08-01")


@query("temperature_high_rt", """
SELECT cd_geocode, nm_municipio, dt_semana_epidemiologica, vl_rt, vl_temp_min, vl_temp_max
FROM v_alertas JOIN v_municipios USING (cd_geocode)
WHERE ds_doenca = 'dengue' AND nr_ano_epi = 1998 AND vl_rt > 1""")
def _(t):
    return reports.temperature_high_rt(t.alerts, t.municipalities, DISEASE, YEAR)


@query("union_sources", """
SELECT cd_geocode, ds_doenca, dt_semana_epidemiologica, vl_casos FROM v_alertas""")
def _(t):
    from sentinela.operators.reshape import union_sources

    columns = ["cd_geocode", "ds_doenca", "dt_semana_epidemiologica", "vl_casos"]
    per_disease = [t.alerts.filter(F.col("ds_doenca") == d).select(*columns) for d in ("dengue", "chikungunya", "zika")]
    return union_sources(per_disease)

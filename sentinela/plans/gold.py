"""Gold models: weekly enriched alerts, annual ranking, demographic profile.

The municipality table has one row per code (its quality suite checks that), so facts are
aggregated by code first and only the much smaller result is joined to names and population.
No join carries a broadcast hint: the dimensions grow with the data, and Spark knows their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sentinela.functions.labels import age_band, alert_name, disease_name, epidemic_flag, sex_or_unknown
from sentinela.functions.numeric import safe_rate
from sentinela.operators.ordering import latest_per_key, rank_descending

NAMES = ["nm_municipio", "nm_microrregiao", "nm_mesorregiao"]
BY_PLACE = ["cd_geocode", "ds_doenca", "nr_ano_epi"]

# Case classification and outcome codes.
CONFIRMED = ["10"]
DEATHS = ["3", "9"]
CURES = ["1"]


def latest_population(population: DataFrame) -> DataFrame:
    """Population of the most recent year per municipality."""
    return latest_per_key(population, ["cd_geocode"], ["dt_ano_referencia"],
                          ["dt_ano_referencia", "vl_populacao"]).select("cd_geocode", "vl_populacao")


def weekly_alerts(alerts: DataFrame, municipalities: DataFrame, population: DataFrame) -> DataFrame:
    """Alerts with place names, population, level name and flags; partition columns last."""
    return (
        alerts.join(municipalities.select("cd_geocode", *NAMES), "cd_geocode", "left")
        .join(latest_population(population), "cd_geocode", "left")
        .select(
            "cd_geocode", *NAMES, "vl_populacao", "nr_semana_epi", "nr_nivel_alerta",
            alert_name(F.col("nr_nivel_alerta")).alias("ds_nivel_alerta"),
            "vl_casos", "vl_casos_estimados", "vl_incidencia", "vl_rt",
            epidemic_flag(F.col("vl_rt"), F.col("vl_transmissao")).alias("fl_epidemia"),
            F.col("vl_transmissao").alias("fl_transmissao"),
            F.col("vl_receptividade").alias("fl_receptividade"),
            "vl_temp_min", "vl_temp_max", "vl_umid_min", "vl_umid_max",
            "nr_ano_epi", "ds_doenca", "dt_semana_epidemiologica",
        )
    )


def annual_burden(alerts: DataFrame, municipalities: DataFrame, population: DataFrame) -> DataFrame:
    """Cases, worst level, weeks by condition and mean Rt per municipality, disease and year."""
    weeks = {
        "nr_semanas_alerta_vermelho": F.col("nr_nivel_alerta") == 4,
        "nr_semanas_alerta_alto": F.col("nr_nivel_alerta") >= 3,
        "nr_semanas_transmissao_ativa": F.col("vl_transmissao") == 1,
        "nr_semanas_rt_acima_1": F.col("vl_rt") > 1.0,
    }
    burden = alerts.groupBy(*BY_PLACE).agg(
        F.sum("vl_casos").alias("vl_total_casos"),
        F.max("nr_nivel_alerta").alias("nr_max_alerta"),
        *[F.count_if(F.coalesce(condition, F.lit(False))).alias(name) for name, condition in weeks.items()],
        F.round(F.avg("vl_rt"), 4).alias("vl_rt_medio"),
    )
    return (
        burden.join(municipalities.select("cd_geocode", *NAMES), "cd_geocode", "left")
        .join(latest_population(population), "cd_geocode", "left")
        .select("cd_geocode", *NAMES, "vl_populacao", "vl_total_casos", "nr_max_alerta", *weeks, "vl_rt_medio",
                "nr_ano_epi", "ds_doenca")
    )


def _incidence() -> Column:
    return safe_rate(F.col("vl_total_casos"), F.col("vl_populacao"), 100_000)


def with_incidence(burden: DataFrame) -> DataFrame:
    """Accumulated cases per 100 thousand inhabitants."""
    return burden.withColumn("vl_incidencia_acumulada", F.round(_incidence(), 2))


RANKING_COLUMNS = [
    "cd_geocode", *NAMES, "vl_populacao", "vl_total_casos", "vl_incidencia_acumulada", "nr_max_alerta",
    "nr_semanas_alerta_vermelho", "nr_semanas_alerta_alto", "nr_semanas_transmissao_ativa",
    "nr_semanas_rt_acima_1", "vl_rt_medio", "nr_rank_estado", "nr_rank_mesorregiao", "nr_ano_epi", "ds_doenca",
]


def annual_ranking(alerts: DataFrame, municipalities: DataFrame, population: DataFrame) -> DataFrame:
    """Annual burden with incidence and its rank within the state and within the mesoregion.

    Ties share a rank, an unknown incidence ranks last. A year and disease hold every
    municipality, so the ranks are computed in pieces instead of one window per year.
    """
    burden = with_incidence(annual_burden(alerts, municipalities, population)).withColumn("_rate", _incidence())
    ranked = rank_descending(
        burden, "_rate", ["nr_ano_epi", "ds_doenca"],
        {"nr_rank_estado": [], "nr_rank_mesorregiao": ["nm_mesorregiao"]}, salt_on=["cd_geocode"])
    return ranked.select(*RANKING_COLUMNS)


def demographic_profile(notifications: DataFrame, municipalities: DataFrame, state: int = 35) -> DataFrame:
    """Notifications, confirmed cases, deaths and cures by place, disease, age band, sex and month.

    Notifications name a municipality by its code without the check digit.
    """
    profile = (
        notifications.filter(F.col("sg_uf") == state)
        .groupBy(
            F.col("id_municip").alias("cd_geocode_ibge"), "id_agravo",
            age_band(F.col("nu_idade_n")).alias("ds_faixa_etaria"),
            sex_or_unknown(F.col("cs_sexo")).alias("cs_sexo"),
            F.year("dt_notific").alias("nr_ano_notificacao"),
            F.month("dt_notific").alias("nr_mes_notificacao"),
        )
        .agg(
            F.count(F.lit(1)).alias("nr_notificacoes"),
            F.count_if(F.coalesce(F.col("classi_fin").isin(CONFIRMED), F.lit(False))).alias("nr_casos_confirmados"),
            F.count_if(F.coalesce(F.col("evolucao").isin(DEATHS), F.lit(False))).alias("nr_obitos"),
            F.count_if(F.coalesce(F.col("evolucao").isin(CURES), F.lit(False))).alias("nr_curas"),
        )
    )
    places = municipalities.select(F.floor(F.col("cd_geocode") / 10).cast("bigint").alias("_code"), *NAMES)
    return profile.join(places, F.col("cd_geocode_ibge") == F.col("_code"), "left").select(
        "cd_geocode_ibge", *NAMES, "id_agravo", disease_name(F.col("id_agravo")).alias("ds_doenca"),
        "ds_faixa_etaria", "cs_sexo", "nr_notificacoes", "nr_casos_confirmados", "nr_obitos", "nr_curas",
        "nr_ano_notificacao", "nr_mes_notificacao",
    )

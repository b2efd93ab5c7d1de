"""Risk scores and regional comparison on the annual ranking of one disease and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sentinela.functions.labels import rt_status, size_class
from sentinela.operators.casting import coerce_numeric
from sentinela.operators.ordering import exact_percentiles

FILLED = [
    "vl_populacao", "vl_total_casos", "vl_incidencia_acumulada", "nr_max_alerta", "nr_semanas_alerta_vermelho",
    "nr_semanas_alerta_alto", "nr_semanas_transmissao_ativa", "nr_semanas_rt_acima_1", "vl_rt_medio",
    "nr_rank_estado", "nr_rank_mesorregiao",
]

# The score's parameters.
MIN_POPULATION = 5_000
MIN_WEEKS = 11
CRITICAL_RT = 0.2
CRITICAL_PERCENTILE = 0.9


def yearly(ranking: DataFrame, disease: str, year: int) -> DataFrame:
    """One disease and year; unknown numbers count as 0."""
    chosen = ranking.filter((F.col("ds_doenca") == disease) & (F.col("nr_ano_epi") == year))
    return coerce_numeric(chosen, FILLED, fill=0.0)


def _adjusted_rt(weeks: Column) -> Column:
    """Mean Rt scaled down when growth lasted only part of the period."""
    return F.col("vl_rt_medio") * F.least(F.col("nr_semanas_rt_acima_1") / weeks, F.lit(1.0))


def with_priority(year: DataFrame) -> DataFrame:
    """Adjusted Rt, priority score and size class.

    The two maxima the score needs are one scalar subquery.
    """
    tops = year.agg(F.struct(
        F.greatest(F.max("nr_semanas_rt_acima_1"), F.lit(float(MIN_WEEKS))).alias("weeks"),
        F.max("vl_incidencia_acumulada").alias("incidence"),
    )).scalar()
    relative = F.coalesce(F.col("vl_incidencia_acumulada") / F.nullif(tops["incidence"], F.lit(0.0)), F.lit(0.0))
    score = F.col("vl_rt_ajustado") * 0.5 + relative * 0.5
    return (
        year.withColumn("vl_rt_ajustado", _adjusted_rt(tops["weeks"]))
        .withColumn("vl_prioridade", F.when(F.col("vl_populacao") < MIN_POPULATION, 0.0).otherwise(score))
        .withColumn("porte", size_class(F.col("vl_populacao")))
        .withColumn("situacao_rt", rt_status(F.col("vl_rt_medio")))
    )


def top_priority(scored: DataFrame, n: int = 20) -> DataFrame:
    return scored.orderBy(F.col("vl_prioridade").desc_nulls_last(), "cd_geocode").limit(n)


def incidence_p90(year: DataFrame) -> DataFrame:
    return exact_percentiles(year, "vl_incidencia_acumulada", {"p90": CRITICAL_PERCENTILE})


def critical_municipalities(scored: DataFrame) -> DataFrame:
    """Sustained growth and an incidence above the 90th percentile of all rows."""
    p90 = incidence_p90(scored).scalar()
    return (
        scored.filter((F.col("vl_rt_ajustado") > CRITICAL_RT) & (F.col("vl_incidencia_acumulada") > p90))
        .orderBy(F.col("vl_prioridade").desc_nulls_last(), "cd_geocode")
    )


def critical_threshold(year: DataFrame) -> DataFrame:
    """Score at which both conditions for a critical municipality are just met."""
    p90 = incidence_p90(year).scalar()
    top = year.agg(F.max("vl_incidencia_acumulada").alias("_top"))
    relative = F.coalesce(p90 / F.nullif(F.col("_top"), F.lit(0.0)), F.lit(0.0))
    return top.select((F.lit(CRITICAL_RT * 0.5) + relative * 0.5).alias("limiar_critico"))


def priority_by_region(scored: DataFrame) -> DataFrame:
    """Priority summed over the two levels of the hierarchy; unknown names are left out."""
    named = scored.filter(F.col("nm_mesorregiao").isNotNull() & F.col("nm_municipio").isNotNull())
    return named.groupBy("nm_mesorregiao", "nm_municipio").agg(F.sum("vl_prioridade").alias("vl_prioridade"))


def by_mesoregion(year: DataFrame) -> DataFrame:
    return (
        year.filter(F.col("nm_mesorregiao").isNotNull()).groupBy("nm_mesorregiao").agg(
            F.sum(F.col("vl_total_casos").cast("double")).alias("total_casos"),
            F.sum(F.col("nr_semanas_alerta_alto").cast("double")).alias("semanas_alerta_alto"),
            F.avg("vl_rt_medio").alias("rt_medio"),
            F.count("nm_municipio").alias("municipios"),
        )
        .withColumn("situacao_rt", rt_status(F.col("rt_medio")))
    )


def mesoregion_median(summary: DataFrame) -> DataFrame:
    return exact_percentiles(summary, "total_casos", {"mediana": 0.5})


def risk_template(ranking: DataFrame, disease: str, year: int, n: int = 20) -> DataFrame:
    """The fixed-period variant: small places are left out of rows, maximum and percentile alike."""
    scope = ranking.filter(
        (F.col("nr_ano_epi") == year) & (F.lower("ds_doenca") == disease.lower())
        & (F.col("vl_populacao") >= MIN_POPULATION))
    p90 = scope.agg(F.percentile_approx("vl_incidencia_acumulada", CRITICAL_PERCENTILE)).scalar()
    adjusted = _adjusted_rt(F.lit(float(MIN_WEEKS)))
    chosen = scope.withColumn("rt_ajustado", adjusted).filter(
        (F.col("rt_ajustado") > CRITICAL_RT) & (F.col("vl_incidencia_acumulada") > p90))
    # Whatever passes the percentile includes the largest value, so it is the maximum of what is left.
    top = chosen.agg(F.max("vl_incidencia_acumulada")).scalar()
    score = F.col("rt_ajustado") * 0.5 + F.col("vl_incidencia_acumulada") / F.nullif(top, F.lit(0.0)) * 0.5
    return (
        chosen.select(
            "cd_geocode", "nm_municipio", "nm_mesorregiao", F.col("vl_populacao").cast("bigint").alias("populacao"),
            "vl_rt_medio", F.col("nr_semanas_rt_acima_1").cast("int").alias("semanas_rt_acima_1"),
            "vl_incidencia_acumulada", "rt_ajustado", score.alias("pontuacao_risco"))
        .orderBy(F.col("pontuacao_risco").desc_nulls_last(), "cd_geocode").limit(n)
    )

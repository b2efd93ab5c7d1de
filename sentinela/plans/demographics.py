"""Reports on the demographic profile of one disease and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sentinela.functions.labels import MONTH_NAMES, SEX_NAMES, lookup
from sentinela.functions.numeric import percent_or_zero
from sentinela.operators.reshape import pivot_sum


def yearly(profile: DataFrame, disease: str, year: int) -> DataFrame:
    return profile.filter((F.col("ds_doenca") == disease) & (F.col("nr_ano_notificacao") == year))


def rates(year: DataFrame) -> DataFrame:
    """Totals with lethality, cure and confirmation rates; 0 where nothing can be divided."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = year.agg(
        total("nr_notificacoes").alias("notificacoes"), total("nr_casos_confirmados").alias("confirmados"),
        total("nr_obitos").alias("obitos"), total("nr_curas").alias("curas"))
    confirmed = F.col("confirmados")
    return sums.withColumns({
        "letalidade": percent_or_zero(F.col("obitos"), confirmed, 2),
        "cura": percent_or_zero(F.col("curas"), confirmed, 2),
        "confirmacao": percent_or_zero(confirmed, F.col("notificacoes"), 2),
    })


def age_pyramid(year: DataFrame) -> DataFrame:
    """Notifications per band and sex, men to the left of zero."""
    men = F.col("cs_sexo") == "M"
    return (
        year.filter(F.col("cs_sexo").isin("M", "F")).groupBy("ds_faixa_etaria", "cs_sexo")
        .agg(F.sum("nr_notificacoes").alias("_n"))
        .select("ds_faixa_etaria", "cs_sexo", F.when(men, -F.col("_n")).otherwise(F.col("_n")).alias("nr_notificacoes"))
    )


def outcome_by_age(year: DataFrame) -> DataFrame:
    """Cures, deaths and all other notifications per band."""
    return (
        year.filter(F.col("ds_faixa_etaria").isNotNull()).groupBy("ds_faixa_etaria").agg(
            F.sum("nr_curas").alias("curas"), F.sum("nr_obitos").alias("obitos"), F.sum("nr_notificacoes").alias("_n"))
        .select("ds_faixa_etaria", "curas", "obitos",
                F.greatest(F.col("_n") - F.col("curas") - F.col("obitos"), F.lit(0)).alias("outros"))
    )


def sex_age_counts(year: DataFrame) -> DataFrame:
    return (
        year.filter(F.col("cs_sexo").isin("M", "F")).groupBy("ds_faixa_etaria", "cs_sexo")
        .agg(F.sum("nr_notificacoes").alias("nr_notificacoes"))
        .withColumn("cs_sexo", lookup(F.col("cs_sexo"), SEX_NAMES, F.col("cs_sexo")))
    )


def seasonality(year: DataFrame) -> DataFrame:
    """Notifications per mesoregion and month, a column per month."""
    placed = year.filter(F.col("nm_mesorregiao").isNotNull())
    return pivot_sum(placed, ["nm_mesorregiao"], "nr_mes_notificacao", MONTH_NAMES, "nr_notificacoes")

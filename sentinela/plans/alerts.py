"""Reports on weekly alerts. ``weekly`` is the gold table of weekly enriched alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sentinela.functions.labels import ALERT_NAMES, ALERT_TITLES, alert_title
from sentinela.functions.numeric import percent_or_zero
from sentinela.operators.filters import at_latest
from sentinela.operators.reshape import wide_to_long

WEEK = "dt_semana_epidemiologica"
CURRENT_COLUMNS = [
    "cd_geocode", "nm_municipio", "nm_microrregiao", "nm_mesorregiao", "vl_populacao", "nr_semana_epi",
    "nr_nivel_alerta", "ds_nivel_alerta", "vl_casos", "vl_incidencia", "vl_rt", "fl_epidemia", "fl_transmissao",
    "fl_receptividade", "vl_temp_min", "vl_temp_max", "nr_ano_epi", "ds_doenca", WEEK,
]
LEVEL_COLUMNS = {1: "green_count", 2: "yellow_count", 3: "orange_count", 4: "red_count"}


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def _mean(column: str) -> Column:
    return F.coalesce(F.avg(column), F.lit(0.0))


def _count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def latest_week(weekly: DataFrame, disease: str) -> DataFrame:
    """All rows of a disease's own latest week."""
    return at_latest(weekly, WEEK, F.col("ds_doenca") == disease)


def current_alerts(weekly: DataFrame, disease: str) -> DataFrame:
    return latest_week(weekly, disease).select(*CURRENT_COLUMNS).orderBy(
        F.col("nr_nivel_alerta").desc_nulls_last(), F.col("vl_incidencia").desc_nulls_last(), "cd_geocode")


def comparative_alerts(weekly: DataFrame) -> DataFrame:
    """Municipalities per disease and level in the latest week of all diseases together.

    A disease that lags behind is therefore absent.
    """
    return (
        at_latest(weekly, WEEK).groupBy("ds_doenca", "nr_nivel_alerta")
        .agg(F.count(F.lit(1)).alias("count_municipalities"))
        .orderBy("ds_doenca", F.col("nr_nivel_alerta").asc_nulls_last())
    )


def mesoregion_summary(weekly: DataFrame, disease: str) -> DataFrame:
    return (
        latest_week(weekly, disease).groupBy("nm_mesorregiao").agg(
            _total("vl_casos").alias("total_cases"),
            _mean("vl_rt").alias("avg_rt"),
            F.coalesce(F.max("nr_nivel_alerta"), F.lit(0)).alias("max_alert_level"),
            _count_where(F.col("nr_nivel_alerta") >= 3).alias("municipalities_high_alert"),
            F.count_distinct("cd_geocode").alias("total_municipalities"),
            _count_where(F.col("fl_epidemia") == 1).alias("municipalities_epidemic"),
        )
        .orderBy(F.col("total_cases").desc_nulls_last(), F.col("nm_mesorregiao").asc_nulls_last())
    )


def kpi_trends(weekly: DataFrame, disease: str, weeks: int = 8) -> DataFrame:
    """Figures of the last weeks, newest first."""
    return (
        weekly.filter(F.col("ds_doenca") == disease).groupBy(WEEK).agg(
            _total("vl_casos").alias("total_cases"),
            _mean("vl_rt").alias("avg_rt"),
            _count_where(F.col("fl_epidemia") == 1).alias("municipalities_epidemic"),
            percent_or_zero(_count_where(F.col("nr_nivel_alerta") == 1), F.count(F.lit(1))).alias("pct_green"),
        )
        .orderBy(F.col(WEEK).desc_nulls_last()).limit(weeks)
    )


def overview_kpis(weekly: DataFrame, disease: str) -> DataFrame:
    """One row of headline figures for the latest week."""
    share = percent_or_zero(F.col("green"), F.col("total_municipalities"))
    return (
        latest_week(weekly, disease).agg(
            _total("vl_casos").alias("total_cases"),
            F.count(F.lit(1)).alias("total_municipalities"),
            F.round(F.avg("vl_rt"), 2).alias("avg_rt"),
            _count_where(F.col("fl_epidemia") == 1).alias("municipalities_in_epidemic"),
            _count_where(F.col("nr_nivel_alerta") == 1).alias("green"),
        )
        .withColumn("pct_green", share)
        .withColumn("status", F.when(F.col("pct_green") > 90, "Controlado").otherwise("Atenção"))
        .drop("green")
    )


def disease_total_max(comparative: DataFrame) -> DataFrame:
    """Largest number of municipalities any disease has."""
    totals = comparative.filter(F.col("ds_doenca").isNotNull()).groupBy("ds_doenca")
    return totals.agg(F.sum("count_municipalities").alias("total")).agg(F.max("total").alias("total_mun_max"))


def active_alert_counts(comparative: DataFrame) -> DataFrame:
    """Municipalities above the green level per disease; an unknown level is not green."""
    return (
        comparative.filter(~F.col("nr_nivel_alerta").eqNullSafe(1) & F.col("ds_doenca").isNotNull())
        .groupBy("ds_doenca").agg(F.sum("count_municipalities").alias("active_municipalities"))
    )


def alert_level_counts(current: DataFrame) -> DataFrame:
    return (
        current.filter(F.col("nr_nivel_alerta").isNotNull()).groupBy("nr_nivel_alerta")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("label", alert_title(F.col("nr_nivel_alerta"), F.col("nr_nivel_alerta").cast("string")))
        .orderBy("nr_nivel_alerta")
    )


def top_mesoregions(summary: DataFrame, n: int = 10) -> DataFrame:
    """Mesoregions with most cases, and the title of their worst level."""
    return (
        summary.orderBy(F.col("total_cases").desc_nulls_last(), F.col("nm_mesorregiao").asc_nulls_last()).limit(n)
        .withColumn("nivel_label", alert_title(F.col("max_alert_level")))
    )


def weekly_series(weekly: DataFrame, disease: str, year: int) -> DataFrame:
    return (
        weekly.filter((F.col("ds_doenca") == disease) & (F.col("nr_ano_epi") == year))
        .groupBy(F.col(WEEK).alias("week_date"), F.col("nr_semana_epi").alias("week_num")).agg(
            _total("vl_casos").alias("total_cases"),
            F.coalesce(F.sum("vl_casos_estimados"), F.lit(0.0)).alias("estimated_cases"),
            _mean("vl_rt").alias("avg_rt"),
            *[_count_where(F.col("nr_nivel_alerta") == level).alias(name) for level, name in LEVEL_COLUMNS.items()],
            F.count_distinct("cd_geocode").alias("municipalities"),
        )
        .orderBy("week_date")
    )


def weekly_series_display(series: DataFrame) -> DataFrame:
    """Table form: empty rows dropped, dates as day/month/year."""
    shown = series.select("week_date", "week_num", "total_cases", "estimated_cases", "avg_rt", "municipalities")
    return shown.na.drop("all").select(
        F.date_format("week_date", "dd/MM/yyyy").alias("data"), F.col("week_num").alias("semana"),
        F.col("total_cases").alias("casos"), F.col("estimated_cases").alias("estimados"),
        F.col("avg_rt").alias("rt_medio"), F.col("municipalities").alias("municipios"),
    )


def alert_levels_long(series: DataFrame) -> DataFrame:
    """One row per week and level."""
    labels = {column: ALERT_TITLES[level] for level, column in LEVEL_COLUMNS.items()}
    return wide_to_long(series, ["week_date"], labels, "nivel", "alertas")


def latest_week_number(weekly: DataFrame, disease: str, year: int) -> DataFrame:
    """Rows of the highest week number within a year."""
    where = (F.lower("ds_doenca") == disease.lower()) & (F.col("nr_ano_epi") == year)
    return at_latest(weekly, "nr_semana_epi", where)


def available_years(table: DataFrame, disease: str, year_column: str = "nr_ano_epi") -> DataFrame:
    return (
        table.filter(F.col("ds_doenca") == disease).select(year_column).distinct()
        .orderBy(F.col(year_column).desc_nulls_last())
    )


def available_years_or(table: DataFrame, disease: str, fallback: list[int], year_column: str = "nr_ano_epi") -> list[int]:
    """Years as a list for a selector (a handful of values), or ``fallback`` when there are none."""
    years = [int(r[0]) for r in available_years(table, disease, year_column).collect() if r[0] is not None]
    return years or fallback


def critical_last_week(alerts: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Level-4 alerts of the latest week, by incidence."""
    return (
        at_latest(alerts, WEEK).filter(F.col("nr_nivel_alerta") == max(ALERT_NAMES))
        .join(municipalities, "cd_geocode")
        .select("cd_geocode", municipalities["nm_municipio"], "ds_doenca", "vl_incidencia", "nr_nivel_alerta")
        .orderBy(F.col("vl_incidencia").desc_nulls_last(), "cd_geocode", "ds_doenca")
    )


def history_weeks(alerts: DataFrame, municipalities: DataFrame, disease: str, as_of: str, weeks: int = 12) -> DataFrame:
    """Estimated cases and mean incidence per week and municipality name, up to ``weeks`` back.

    Cases are summed per municipality code before names are joined; means are combined from
    their sums and counts.
    """
    since = F.date_sub(F.lit(as_of).cast("date"), 7 * weeks)
    by_code = (
        alerts.filter((F.col("ds_doenca") == disease) & (F.col(WEEK) >= since))
        .groupBy(F.date_trunc("week", WEEK).cast("date").alias("semana"), "cd_geocode").agg(
            F.sum("vl_casos_estimados").alias("_cases"),
            F.sum("vl_incidencia").alias("_incidence"),
            F.count("vl_incidencia").alias("_n"),
        )
    )
    return (
        by_code.join(municipalities, "cd_geocode").groupBy("semana", "nm_municipio").agg(
            F.sum("_cases").cast("double").alias("total_casos"),
            (F.sum("_incidence").cast("double") / F.nullif(F.sum("_n"), F.lit(0))).alias("incidencia_media"),
        )
        .orderBy(F.col("semana").desc(), F.col("total_casos").desc_nulls_last(), "nm_municipio")
    )


def temperature_high_rt(alerts: DataFrame, municipalities: DataFrame, disease: str, year: int) -> DataFrame:
    """Temperatures in the weeks of a year in which Rt was above 1."""
    return (
        alerts.filter((F.col("ds_doenca") == disease) & (F.col("vl_rt") > 1.0) & (F.col("nr_ano_epi") == year))
        .join(municipalities, "cd_geocode")
        .select("cd_geocode", municipalities["nm_municipio"], WEEK, "vl_rt", "vl_temp_min", "vl_temp_max")
        .orderBy(F.col("vl_rt").desc(), "cd_geocode", WEEK)
    )

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sentinela.operators import aggregates
from sentinela.operators.filters import filter_dates, filter_members, filter_value, search_text
from sentinela.operators.nested import (
    explode_quality_tests, legacy_info_json, normalize_quality_info, parse_json_field,
)
from sentinela.operators.reshape import pivot_sum, union_sources, wide_to_long
from sentinela.plans import alerts, demographics, gold, observability, ranking
from tests.conftest import rows

MUNICIPALITIES = "cd_geocode bigint, nm_municipio string, nm_microrregiao string, nm_mesorregiao string"


def test_filters(spark):
    df = spark.createDataFrame([("a", "2026-01-01"), ("ab", "2026-02-01"), (None, "soon")], "k string, d string")
    assert rows(filter_value(df, "k", "a"), "k") == [("a",)]
    assert rows(filter_value(df, "k", "*reb$"), "k") == [("ab",)]
    assert filter_dates(df, "d").count() == 3
    assert rows(filter_dates(df, "d", "2026-01-01", "2026-01-31"), "k") == [("a",)]
    assert rows(filter_dates(df, "d", start="2026-01-02"), "k") == [("ab",)]
    assert filter_members(df, k=["a", "ab", None]).count() == 2
    assert rows(search_text(df, "k", "B"), "k") == [("ab",)]


def test_date_bounds_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = filter_dates(orders, "o_orderdate", datetime(1998, 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_group_aggregate(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 5.0), (None, 9.0)], "g string, v double")
    assert rows(aggregates.group_aggregate(df, ["g"])) == [("x", 2), ("y", 1)]
    assert aggregates.group_aggregate(df, ["g"], "mean", "v", limit=1).collect()[0][:] == ("y", 5.0)
    assert aggregates.group_aggregate(df, ["g"], "max", "v", ascending=True).first()[0] == "x"
    assert rows(aggregates.group_aggregate(df, ["g"], "median", "v")) == [("x", 3.0), ("y", 5.0)]


def test_kpis(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None)], "k int, v double")
    got = aggregates.kpis(df, {"n": {}, "a": {"operation": "avg", "column": "v", "label": "mean"},
                               "u": {"operation": "unique", "column": "k"}, "no": {"operation": "max", "column": "z"},
                               "what": {"operation": "x", "column": "k"}}).first().asDict()
    assert got == {"n": 2, "mean": 1.0, "u": 1, "no": 0, "what": None}
    assert aggregates.kpis(df.limit(0), {"s": {"operation": "sum", "column": "v"}}).first()[0] == 0


def test_time_series_fills_gaps(spark):
    df = spark.createDataFrame([(date(2026, 1, 30), 1.0), (date(2026, 2, 2), 2.0), (date(2026, 4, 1), None), (None, 7.0)],
                               "d date, v double")
    daily = rows(aggregates.time_series(df, "d", "D"))
    assert len(daily) == 62 and daily[:2] == [(date(2026, 1, 30), 1), (date(2026, 1, 31), 0)]
    weekly = rows(aggregates.time_series(df, "d", "W"))
    assert weekly[:2] == [(date(2026, 2, 1), 1), (date(2026, 2, 8), 1)] and weekly[-1] == (date(2026, 4, 5), 1)
    assert len(weekly) == 10
    assert rows(aggregates.time_series(df, "d", "M", "sum", "v")) == [
        (date(2026, 1, 31), 1.0), (date(2026, 2, 28), 2.0), (date(2026, 3, 31), 0.0), (date(2026, 4, 30), 0.0)]
    extremes = dict(rows(aggregates.time_series(df, "d", "M", "max", "v")))
    assert extremes[date(2026, 3, 31)] is None and extremes[date(2026, 1, 31)] == 1.0
    with pytest.raises(ValueError):
        aggregates.time_series(df, "d", "Q")


def test_failures_and_rates(spark):
    df = spark.createDataFrame([("a", "SUCCEEDED"), ("a", "FAILED"), ("b", None), (None, "failed")], "j string, status string")
    assert rows(aggregates.top_failures(df, "j")) == [("a", 1), ("b", 1)]
    assert rows(aggregates.top_failures(df)) == [(3,)]
    assert rows(aggregates.top_failures(df.filter("status = 'SUCCEEDED'"))) == []
    assert rows(aggregates.top_failed_tests(df, "j")) == [("a", 1)]
    assert rows(aggregates.success_rate(df)) == [(25.0,)]
    assert rows(aggregates.success_rate(df.limit(0))) == [(0.0,)]
    assert rows(aggregates.value_counts(df, "status")) == [("FAILED", 1), ("SUCCEEDED", 1), ("failed", 1)]


def test_reshape(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, None)], "k string, x int, y int")
    assert rows(wide_to_long(df, ["k"], {"x": "X", "y": "Y"}, "name", "value")) == [
        ("a", "X", 1), ("a", "Y", 2), ("b", "X", 3), ("b", "Y", None)]
    sums = pivot_sum(df, ["k"], "x", {1: "one", 3: "three"}, "x")
    assert rows(sums) == [("a", 1, 0), ("b", 0, 3)]
    assert union_sources([df, df.select("y", "x", "k")]).count() == 4


def test_json_fields(spark):
    df = spark.createDataFrame([('{"k": 5}',), ("not json",), (None,)], "s string")
    assert rows(df.select(parse_json_field(F.col("s"), "k int")["k"])) == [(None,), (None,), (5,)]
    info = spark.createDataFrame([
        ('{"column": "a", "test_type": "t", "status": "passed", "timestamp": "x", "threshold": 3}',),
        ('{"column_name": "b", "test": "u", "result": "Failed", "executed_at": "y"}',), ("oops",)], "info string")
    got = rows(normalize_quality_info(info), "column_tested", "test_applied", "test_status", "execution_timestamp", "threshold")
    assert got == [("a", "t", "PASSED", "x", "3"), ("b", "u", "FAILED", "y", None), ("unknown", "unknown", "UNKNOWN", None, None)]


def test_quality_tests_from_old_and_new_records(spark):
    old = "{'x': None, 'ok': True, 'quality_tests': [{'column_tested': 'a', 'test_applied': 't', 'status': 'failure'}, {'column_tested': 'b'}]}"
    new = '{"quality_tests": [{"column_tested": "it\'s", "test_applied": "t", "status": "success"}]}'
    df = spark.createDataFrame([(1, "tb", "j", old), (2, "tb", "j", new), (3, "tb", "j", "???"), (4, "tb", "j", None)],
                               "start_execution int, table_name string, job_name string, info string")
    assert rows(explode_quality_tests(df), "start_execution", "column_tested", "status") == [
        (1, "a", "failure"), (1, "b", ""), (2, "it's", "success")]
    assert df.select(legacy_info_json(F.col("info"))).first()[0].startswith('{"x": null, "ok": true')


@pytest.fixture()
def places(spark):
    return spark.createDataFrame([(11, "A", "m1", "M1"), (21, "B", "m1", "M1"), (31, "C", "m2", "M2")], MUNICIPALITIES)


def test_annual_ranking(spark, places):
    week = date(2026, 1, 5)
    facts = [(11, "dengue", 2026, week, 1, 4, 10, 1.5, 1), (11, "dengue", 2026, date(2026, 1, 12), 2, 3, 10, None, 0),
             (21, "dengue", 2026, week, 1, 1, 40, 0.5, 1), (31, "dengue", 2026, week, 1, 2, 5, 2.0, None),
             (99, "dengue", 2026, week, 1, 2, 5, 2.0, None)]
    df = spark.createDataFrame(facts, "cd_geocode bigint, ds_doenca string, nr_ano_epi int, dt_semana_epidemiologica date, "
                               "nr_semana_epi int, nr_nivel_alerta int, vl_casos bigint, vl_rt double, vl_transmissao int")
    people = spark.createDataFrame([(11, 2024, 5), (11, 2025, 1000), (21, 2025, 2000), (31, 2025, 0)],
                                   "cd_geocode bigint, dt_ano_referencia int, vl_populacao bigint")
    got = rows(gold.annual_ranking(df, places, people), "cd_geocode", "vl_populacao", "vl_total_casos",
               "vl_incidencia_acumulada", "nr_max_alerta", "nr_semanas_alerta_alto", "nr_semanas_transmissao_ativa",
               "nr_semanas_rt_acima_1", "vl_rt_medio", "nr_rank_estado", "nr_rank_mesorregiao")
    assert got == [
        (11, 1000, 20, 2000.0, 4, 2, 1, 1, 1.5, 1, 1), (21, 2000, 40, 2000.0, 1, 0, 1, 0, 0.5, 1, 1),
        (31, 0, 5, None, 2, 0, 0, 1, 2.0, 3, 1), (99, None, 5, None, 2, 0, 0, 1, 2.0, 3, 1)]


def test_demographic_profile(spark, places):
    df = spark.createDataFrame(
        [("A90", date(2026, 1, 3), 1, 35, 400, "", "10", "3"), ("A90", date(2026, 1, 9), 1, 35, 400, None, "0", "1"),
         ("X", date(2026, 2, 1), 7, 35, None, "F", None, None), ("A90", date(2026, 1, 3), 1, 33, 400, "M", "10", "3")],
        "id_agravo string, dt_notific date, id_municip bigint, sg_uf int, nu_idade_n int, cs_sexo string, classi_fin string, evolucao string")
    assert rows(gold.demographic_profile(df, places)) == [
        (1, "A", "m1", "M1", "A90", "dengue", "0-4", "I", 2, 1, 1, 1, 2026, 1),
        (7, None, None, None, "X", "X", "60+", "F", 1, 0, 0, 0, 2026, 2)]


def _year(spark, data):
    return spark.createDataFrame(data, "cd_geocode bigint, nm_municipio string, nm_mesorregiao string, vl_populacao double, "
                                 "vl_total_casos double, vl_incidencia_acumulada double, nr_semanas_alerta_alto double, "
                                 "nr_semanas_rt_acima_1 double, vl_rt_medio double")


def test_priority(spark):
    year = _year(spark, [(1, "A", "M", 9000.0, 5.0, 100.0, 1.0, 22.0, 1.5), (2, "B", "M", 9000.0, 5.0, 50.0, 1.0, 11.0, 1.0),
                         (3, "C", "N", 4999.0, 1.0, 200.0, 1.0, 22.0, 3.0)])
    got = {r["nm_municipio"]: r for r in ranking.with_priority(year).collect()}
    assert got["A"]["vl_prioridade"] == 1.5 * 0.5 + 100 / 200 * 0.5
    assert got["B"]["vl_rt_ajustado"] == 0.5 and got["C"]["vl_prioridade"] == 0.0 and got["A"]["porte"] == "Pequeno"
    assert [r["cd_geocode"] for r in ranking.top_priority(ranking.with_priority(year), 2).collect()] == [1, 2]
    assert [r["cd_geocode"] for r in ranking.critical_municipalities(ranking.with_priority(year)).collect()] == [3]
    assert ranking.critical_threshold(year).first()[0] == pytest.approx(0.1 + 180 / 200 * 0.5)
    assert ranking.mesoregion_median(ranking.by_mesoregion(year)).first()[0] == 5.5


def test_priority_without_incidence(spark):
    """All incidences 0: the relative part counts as 0 and is not undefined."""
    year = _year(spark, [(1, "A", "M", 9000.0, 0.0, 0.0, 0.0, 0.0, 0.0)])
    assert ranking.with_priority(year).first()["vl_prioridade"] == 0.0
    assert ranking.critical_threshold(year).first()[0] == 0.1


def test_reports_on_weekly_alerts(spark):
    facts = [(1, "A", "dengue", date(2026, 1, 12), 1, 1), (2, "B", "dengue", date(2026, 1, 12), 4, 0),
             (1, "A", "dengue", date(2026, 1, 5), 2, 0), (1, "A", "zika", date(2026, 1, 5), 3, 0)]
    weekly = spark.createDataFrame(facts, "cd_geocode bigint, nm_mesorregiao string, ds_doenca string, "
                                   "dt_semana_epidemiologica date, nr_nivel_alerta int, fl_epidemia int").withColumns(
        {"vl_casos": F.lit(3), "vl_rt": F.lit(1.5), "nr_ano_epi": F.lit(2026)})
    compared = alerts.comparative_alerts(weekly)
    assert rows(compared) == [("dengue", 1, 1), ("dengue", 4, 1)]  # zika lags a week behind
    assert rows(alerts.disease_total_max(compared)) == [(2,)]
    assert rows(alerts.active_alert_counts(compared)) == [("dengue", 1)]
    kpis = alerts.overview_kpis(weekly, "dengue").first().asDict()
    assert kpis == {"total_cases": 6, "total_municipalities": 2, "avg_rt": 1.5, "municipalities_in_epidemic": 1,
                    "pct_green": 50.0, "status": "Atenção"}
    assert [r[0] for r in alerts.kpi_trends(weekly, "dengue", weeks=1).collect()] == [date(2026, 1, 12)]
    assert alerts.available_years_or(weekly, "dengue", [2000]) == [2026]
    assert alerts.available_years_or(weekly, "none", [2000]) == [2000]
    assert [r["nivel_label"] for r in alerts.top_mesoregions(alerts.mesoregion_summary(weekly, "dengue"), 1).collect()] == ["Verde"]


def test_demographic_reports(spark):
    year = spark.createDataFrame([("0-4", "M", 5, 2, 1, 1, 1, "X"), ("0-4", "F", 1, 0, 1, 1, 2, None)],
                                 "ds_faixa_etaria string, cs_sexo string, nr_notificacoes int, nr_casos_confirmados int, "
                                 "nr_obitos int, nr_curas int, nr_mes_notificacao int, nm_mesorregiao string")
    assert rows(demographics.age_pyramid(year)) == [("0-4", "F", 1), ("0-4", "M", -5)]
    assert rows(demographics.outcome_by_age(year)) == [("0-4", 2, 2, 2)]
    assert rows(demographics.outcome_by_age(year.filter("cs_sexo = 'F'"))) == [("0-4", 1, 1, 0)]
    assert rows(demographics.seasonality(year))[0][:3] == ("X", 5, 0)
    assert demographics.rates(year).first()["letalidade"] == 100.0
    assert demographics.rates(year.limit(0)).first().asDict() == {
        "notificacoes": 0, "confirmados": 0, "obitos": 0, "curas": 0, "letalidade": 0.0, "cura": 0.0, "confirmacao": 0.0}


def test_run_reports(spark):
    moment = datetime(2026, 1, 1, 10)
    runs = spark.createDataFrame(
        [(1, moment, datetime(2026, 1, 1, 10, 0, 30), "j1", "success", None, True, date(2026, 1, 1)),
         (2, moment, None, "j1", "error", "w", True, date(2025, 1, 1)), (3, None, moment, "j2", "FAILED", None, None, None)],
        "event_id int, start_execution timestamp_ntz, end_execution timestamp_ntz, job_name string, status string, "
        "warning_description string, critical_table boolean, dt_ref date")
    assert observability.metrics(runs).first()[:] == (3, pytest.approx(100 / 3), 2, 1, 30.0)
    assert rows(observability.mean_duration_by_job(runs)) == [("j1", 30.0)]
    assert rows(observability.critical_failures(runs, "error"), "event_id") == [(2,)]
    assert observability.critical_failures(runs).count() == 0
    assert rows(observability.recent(runs, "2026-01-31", days=90), "event_id") == [(1,)]
    assert rows(observability.per_day(runs)) == [(date(2026, 1, 1), 2)]

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sentinela.config import IngestSpec, QualitySpec, RefineSpec
from sentinela.operators.quality import QualityFailure
from sentinela.plans.defaults import columns, create_table
from sentinela.plans.jobs import bronze_to_silver, silver_to_gold
from sentinela.sinks.files import dated_path, land_json, write_csv, write_parquet
from sentinela.sinks.jdbc import jdbc_write_options
from sentinela.sinks.runlog import RunLog, execution_id, read_runs
from sentinela.sinks.tables import OVERWRITE_MODE, insert_into, upsert_into
from sentinela.sources.json import read_json
from sentinela.staging import scratch_root, scratch_scope, stage
from tests.conftest import rows

SCHEMA = "{'cd_geocode': 'int', 'ds_doenca': 'string', 'dt_semana': ['date', 'yyyy-MM-dd'], 'vl_rt': 'double'}"


@pytest.fixture()
def table(spark, folder):
    name = "t_" + os.path.basename(folder).replace("-", "_")
    spark.sql(f"CREATE TABLE {name} (ds_doenca STRING, vl_rt DOUBLE, dt_semana DATE, cd_geocode INT) "
              f"USING parquet PARTITIONED BY (cd_geocode) LOCATION '{folder}/table'")
    yield name
    spark.sql(f"DROP TABLE {name}")


def land(folder, name, text, day="2026-02-01"):
    os.makedirs(f"{folder}/bronze/ingestion_date={day}", exist_ok=True)
    with open(f"{folder}/bronze/ingestion_date={day}/{name}", "w") as f:
        f.write(text)


def spec(folder, table, **more):
    return IngestSpec.parse({
        "trgt_tbl": "monitor_tb_alertas", "ext": "csv", "sep": ",", "bronze_path": f"{folder}/bronze",
        "silver_table": table, "table_schema": SCHEMA, "partition_column": "cd_geocode",
        "options_params": {"normalize_schema": True}, **more})


CSV = "DS_DOENCA,CD_GEOCODE,DT_SEMANA,VL_RT\n dengue ,1,2026-01-04,\"1,5\"\nzika,2,2026-13-01,0.9\n"


def test_ingest_all_files_of_a_date(spark, folder, table):
    land(folder, "a.csv", CSV)
    land(folder, "b.csv", "cd_geocode,vl_rt,ds_doenca\n3,2,chik\n")
    land(folder, "old.csv", CSV, day="2026-01-01")
    log = RunLog(spark, f"{folder}/logs", "job", "monitor_tb_alertas", "silver")
    assert bronze_to_silver(spark, spec(folder, table), "2026-02-01", log=log)["rows"] == 3
    assert rows(spark.table(table)) == [
        ("chik", 2.0, None, 3), ("dengue", 1.5, date(2026, 1, 4), 1), ("zika", 0.9, None, 2)]
    record = read_runs(spark, f"{folder}/logs").first()
    assert (record["status"], record["count"], record["source"], record["table_name"]) == (
        "success", 3, "monitor", "tb_alertas")
    assert {"read_and_cast", "insert_table"} <= set(record["info"])


def test_ingest_one_file_and_overwrite_only_its_partitions(spark, folder, table):
    land(folder, "a.csv", CSV)
    land(folder, "b.csv", "CD_GEOCODE,VL_RT,DS_DOENCA,DT_SEMANA\n2,7,zika,2026-01-11\n")
    before = spark.conf.get(OVERWRITE_MODE)
    bronze_to_silver(spark, spec(folder, table), "2026-02-01", "a.csv")
    bronze_to_silver(spark, spec(folder, table), "2026-02-01", "b.csv")
    assert rows(spark.table(table)) == [("dengue", 1.5, date(2026, 1, 4), 1), ("zika", 7.0, date(2026, 1, 11), 2)]
    bronze_to_silver(spark, spec(folder, table), "2026-02-01", "b.csv", partitions="static")
    assert rows(spark.table(table)) == [("zika", 7.0, date(2026, 1, 11), 2)]
    assert spark.conf.get(OVERWRITE_MODE) == before


def test_ingest_filters(spark, folder, table):
    land(folder, "a.csv", CSV)
    bronze_to_silver(spark, spec(folder, table, filter_column="ds_doenca", filter_value="*re^zi"), "2026-02-01")
    assert [r[0] for r in rows(spark.table(table))] == ["zika"]


def test_ingest_json_with_append(spark, folder, table):
    land(folder, "a.json", '{"rows": [{"cd_geocode": 1, "ds_doenca": "dengue", "dt_semana": "2026-01-04", "vl_rt": 1}]}')
    job = spec(folder, table, ext="json", explode_column="rows", options_params=None, mode="append")
    bronze_to_silver(spark, job, "2026-02-01")
    bronze_to_silver(spark, job, "2026-02-01")
    assert spark.table(table).count() == 2


def test_ingest_fixed_width_with_header_date(spark, folder, table):
    land(folder, "a.txt", "H 20260104\n1dengue 1.5\n2zika   0.9\nTOTAL 2\n")
    job = IngestSpec.parse({
        "trgt_tbl": "monitor_tb_alertas", "ext": "txt", "bronze_path": f"{folder}/bronze", "silver_table": table,
        "table_schema": {"cd_geocode": "int", "ds_doenca": "string", "vl_rt": "double"},
        "layout": [["cd_geocode", 0, 1], ["ds_doenca", 1, 8], ["vl_rt", 8, 11]], "skip_header": 1, "skip_footer": "true",
        "lit_values": {"column_name": "dt_semana", "mask": "yyyyMMdd", "value": "row,0,2:10"},
        "partition_column": "cd_geocode"})
    assert bronze_to_silver(spark, job, "2026-02-01")["rows"] == 2
    assert rows(spark.table(table)) == [("dengue", 1.5, date(2026, 1, 4), 1), ("zika", 0.9, date(2026, 1, 4), 2)]


def test_quality_warns_or_stops(spark, folder, table):
    land(folder, "a.csv", CSV)
    checks = {"trgt_tbl": "monitor_tb_alertas", "quality_params": {"not_null": {"column": "dt_semana"}}}
    job = spec(folder, table, has_bdq=True)
    log = RunLog(spark, f"{folder}/logs", "job", "monitor_tb_alertas", "silver")
    with pytest.raises(QualityFailure):
        bronze_to_silver(spark, job, "2026-02-01", quality=QualitySpec.parse({**checks, "stop_job": True}), log=log)
    assert spark.table(table).count() == 0
    assert read_runs(spark, f"{folder}/logs").first()["status"] == "error"
    log = RunLog(spark, f"{folder}/logs2", "job", "monitor_tb_alertas", "silver")
    done = bronze_to_silver(spark, job, "2026-02-01", quality=QualitySpec.parse(checks), log=log)
    assert done["quality"][0]["status"] == "failure" and spark.table(table).count() == 2
    record = read_runs(spark, f"{folder}/logs2").first()
    assert (record["status"], record["has_bdq"], record["quality_tests"][0]["status"]) == ("warning", True, "failure")
    with pytest.raises(ValueError):
        bronze_to_silver(spark, job, "2026-02-01")


def test_unsupported_extension(spark, folder, table):
    with pytest.raises(ValueError, match="unsupported extension"):
        bronze_to_silver(spark, spec(folder, table, ext="xml"), "2026-02-01")


def test_upsert_mode(spark, folder, table):
    land(folder, "a.csv", CSV)
    land(folder, "b.csv", "CD_GEOCODE,VL_RT,DS_DOENCA,DT_SEMANA\n2,7,zika,2026-01-11\n9,1,zika,2026-01-11\n")
    bronze_to_silver(spark, spec(folder, table), "2026-02-01", "a.csv")
    bronze_to_silver(spark, spec(folder, table, mode="merge", merge_keys=["cd_geocode"]), "2026-02-01", "b.csv")
    assert sorted((r[3], r[1]) for r in rows(spark.table(table))) == [(1, 1.5), (2, 7.0), (9, 1.0)]


def _upsert(spark, folder, table, changes, columns="cd_geocode int, ds_doenca string, vl_rt double"):
    """A table partitioned by disease, and the rows it has after an upsert by code."""
    name = table + "_u"
    spark.sql(f"CREATE TABLE {name} (cd_geocode INT, vl_rt DOUBLE, ds_doenca STRING) USING parquet "
              f"PARTITIONED BY (ds_doenca) LOCATION '{folder}/u'")
    try:
        start = [(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0), (4, None, 4.0), (5, "c", 5.0)]
        insert_into(spark.createDataFrame(start, columns), name, "append")
        untouched = sorted(os.listdir(f"{folder}/u/ds_doenca=c"))
        upsert_into(spark.createDataFrame(changes, columns), name, ["cd_geocode"])
        kept = sorted(os.listdir(f"{folder}/u/ds_doenca=c")) == untouched
        return rows(spark.table(name), "cd_geocode", "ds_doenca", "vl_rt"), kept
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_upsert_rewrites_only_touched_partitions(spark, folder, table):
    got, kept = _upsert(spark, folder, table, [(2, "b", 9.0), (4, None, 8.0), (6, "d", 6.0)])
    assert got == [(1, "a", 1.0), (2, "b", 9.0), (3, "b", 3.0), (4, None, 8.0), (5, "c", 5.0), (6, "d", 6.0)]
    assert kept


def test_upsert_that_empties_a_partition(spark, folder, table):
    got, kept = _upsert(spark, folder, table, [(3, "a", 7.0)])
    assert got == [(1, "a", 1.0), (2, "a", 2.0), (3, "a", 7.0), (4, None, 4.0), (5, "c", 5.0)]
    assert kept and not os.path.exists(f"{folder}/u/ds_doenca=b")


def test_upsert_refuses_a_key_that_occurs_twice(spark, folder, table):
    with pytest.raises(ValueError, match="several source rows"):
        _upsert(spark, folder, table, [(3, "a", 7.0), (3, "b", 8.0)])


def test_jobs_free_what_they_stage(spark):
    kept = stage(spark.range(3), "outside")
    with scratch_scope(spark):
        inside = stage(spark.range(3), "inside").inputFiles()[0].replace("file://", "")
        assert os.path.exists(inside)
    assert not os.path.exists(inside) and kept.count() == 3


def test_execution_id_of_a_column_is_that_of_a_run(spark, folder):
    log = RunLog(spark, folder, "job", "src_tb_x", "silver", clock=lambda: datetime(2026, 1, 2, 3, 4, 5))
    df = spark.sql("SELECT 'job' AS j, 'src_tb_x' AS t, TIMESTAMP_NTZ '2026-01-02 03:04:05' AS s")
    assert df.select(execution_id(*[df[c] for c in "jts"])).first()[0] == log.record["execution_id"]


def test_write_left_to_sql(spark, folder, table):
    df = spark.sql("SELECT 5 AS cd_geocode, 'x' AS ds_doenca, DATE '2026-01-01' AS dt_semana, 1D AS vl_rt")
    insert_into(df, table, "iceberg", merge_sql=f"INSERT INTO {table} SELECT * FROM source_table")
    assert rows(spark.table(table)) == [("x", 1.0, date(2026, 1, 1), 5)]
    for mode in ("iceberg", "upsert"):
        with pytest.raises(ValueError):
            insert_into(df, table, mode)


def test_silver_to_gold(spark, folder):
    spark.sql("CREATE DATABASE IF NOT EXISTS gold")
    spark.sql(f"CREATE TABLE gold.tb_ft_soma (n BIGINT, p INT) USING parquet PARTITIONED BY (p) LOCATION '{folder}/g'")
    job = RefineSpec.parse({"target_table": "gold_tb_ft_soma"})
    text = "SELECT CAST(id % 3 AS INT) AS p, count(*) AS n FROM {t} WHERE id < :top GROUP BY 1"
    try:
        log = RunLog(spark, f"{folder}/logs", "refine", "gold_tb_ft_soma", "gold")
        assert silver_to_gold(spark, job, text, {"top": 10}, {"t": spark.range(100)}, log) == 3
        assert silver_to_gold(spark, job, lambda: spark.sql("SELECT 99L AS n, 2 AS p")) == 1
        assert rows(spark.table("gold.tb_ft_soma")) == [(3, 1), (4, 0), (99, 2)]
        assert read_runs(spark, f"{folder}/logs").first()["count"] == 3
        with pytest.raises(ValueError):
            silver_to_gold(spark, job, "  ")
    finally:
        spark.sql("DROP TABLE gold.tb_ft_soma")


def test_run_log_life_cycle(spark, folder):
    moments = iter([datetime(2026, 1, 1, 23, 0, 0), datetime(2026, 1, 1, 23, 0, 2, 500000), datetime(2026, 1, 2, 0, 1)])
    log = RunLog(spark, folder + "/l", "job", "nounderscore", "silver", clock=lambda: next(moments))
    log.add(file_name="f.csv", custom=5)
    log.step("read")
    log.warning("slow")
    log.write()
    record = read_runs(spark, folder + "/l").first()
    assert record["info"] == {"custom": "5", "read": "2.5"}
    assert (record["status"], record["warning_description"], record["file_name"]) == ("warning", "slow", "f.csv")
    assert record["dt_ref"] == date(2026, 1, 1) and len(record["execution_id"]) == 64
    assert os.listdir(folder + "/l/dt_ref=2026-01-01")


def test_files(spark, folder):
    df = spark.createDataFrame([(1, "a;b"), (2, None)], "k int, s string")
    assert write_csv(df, f"{folder}/c", sep=";") == 2
    assert any(f.endswith(".csv.gz") for f in os.listdir(f"{folder}/c"))
    assert write_parquet(df, f"{folder}/p", ["k"]) == 2
    assert "k=1" in os.listdir(f"{folder}/p")
    path = land_json(df, f"{folder}/j", "2026-02-01")
    assert path.endswith("ingestion_date=2026-02-01")
    assert rows(spark.read.json(f"{folder}/j"), "k", "s", "ingestion_date") == [
        (1, "a;b", date(2026, 2, 1)), (2, None, date(2026, 2, 1))]
    assert dated_path("/r/", "src_tb_x", date(2026, 2, 1)) == "/r/src/tb_x/20260201"


def test_landed_json_is_compressed_in_files_of_bounded_length(spark, folder):
    df = spark.range(1000).select(F.col("id").alias("cd_geocode"), F.lit("dengue").alias("ds_doenca"),
                                  F.when(F.col("id") % 3 > 0, F.col("id") / 4).alias("vl_rt")).coalesce(1)
    path = land_json(df, folder, "2026-02-01", records_per_file=300)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) == 4 and all(f.endswith(".json.gz") for f in files)
    plain = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).agg(F.sum(F.length("j") + 1)).first()[0]
    assert sum(os.path.getsize(f"{path}/{f}") for f in files) < plain / 5
    back = read_json(spark, path, schema=df.schema, multiline=False)
    assert rows(back) == rows(df)
    assert spark.read.text(path).filter(F.col("value").contains('"vl_rt":null')).count() == 334


def test_jdbc_write_options():
    options = jdbc_write_options("u", "t", "me", "pw", "overwrite", driver="d")
    assert options["truncate"] == "true" and options["batchsize"] == "10000" and options["driver"] == "d"
    assert "truncate" not in jdbc_write_options("u", "t", "me", "pw", "append")
    with pytest.raises(ValueError):
        jdbc_write_options("u", "t", "me", "pw", "merge")


def test_staging(spark):
    staged = stage(spark.range(10), "x")
    assert staged.count() == 10 and scratch_root(spark) in staged.inputFiles()[0].replace("file://", "")


def test_gold_rows_fit_the_declared_table(spark, folder):
    """Counts and ranks are 64-bit in the plan and narrowed, with an overflow check, by the table."""
    name = "t_" + os.path.basename(folder).replace("-", "_") + "_r"
    create_table(spark, name, "tb_ft_ranking_anual", f"{folder}/r")
    try:
        row = ", ".join(f"CAST({7 if kind != 'string' else chr(39) + 'x' + chr(39)} AS "
                        f"{'BIGINT' if kind == 'int' else kind}) AS {c}" for c, kind in columns("tb_ft_ranking_anual").items())
        insert_into(spark.sql(f"SELECT {row}"), name, "overwrite")
        assert spark.table(name).first()["nr_rank_estado"] == 7
    finally:
        spark.sql(f"DROP TABLE {name}")


@pytest.fixture()
def disease_table(spark, folder):
    """Rows by disease; gives the table's name and a function of its rows."""
    name = "w_" + os.path.basename(folder).replace("-", "_")
    spark.sql(f"CREATE TABLE {name} (k INT, v DOUBLE, d STRING) USING parquet PARTITIONED BY (d) LOCATION '{folder}/w'")
    insert_into(spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "a"), (3, 3.0, "b"), (4, 4.0, "c")], "k int, v double, d string"),
                name, "append")
    yield name, lambda: rows(spark.table(name), "k", "d", "v")
    spark.sql(f"DROP TABLE {name}")


BEFORE = [(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0), (4, "c", 4.0)]
AFTER = [(1, "a", 1.0), (2, "a", 2.0), (3, "a", 9.0), (4, "c", 4.0), (5, "d", 5.0)]


class Crash(Exception):
    pass


def crash(*args, **kwargs):
    raise Crash


@pytest.mark.parametrize("at, whole", [
    ("pending.commit", BEFORE), ("_insert", AFTER), ("drop_partition", AFTER), ("pending.delete", AFTER)])
def test_upsert_cut_short_leaves_one_state_or_the_other(spark, disease_table, monkeypatch, at, whole):
    from sentinela.sinks import pending, tables

    name, found = disease_table
    change = spark.createDataFrame([(3, 9.0, "a"), (5, 5.0, "d")], "k int, v double, d string")
    with monkeypatch.context() as m:
        m.setattr(f"sentinela.sinks.{at}" if "." in at else f"sentinela.sinks.tables.{at}", crash)
        with pytest.raises(Crash):
            upsert_into(change, name, ["k"])
        assert len(pending.folders(spark, name)) == 1
    if at == "drop_partition":
        # The written rows are there, the moved one also in its old place, until the upsert is finished.
        spark.catalog.refreshTable(name)
        assert (3, "b", 3.0) in found() and (3, "a", 9.0) in found()
    assert tables.recover_upserts(spark, name) == (0 if whole is BEFORE else 1)
    assert found() == whole and pending.folders(spark, name) == []
    assert tables.recover_upserts(spark, name) == 0 and found() == whole


def test_later_writes_finish_an_upsert_first(spark, disease_table, monkeypatch):
    name, found = disease_table
    with monkeypatch.context() as m:
        m.setattr("sentinela.sinks.tables.drop_partition", crash)
        with pytest.raises(Crash):
            upsert_into(spark.createDataFrame([(3, 9.0, "a"), (5, 5.0, "d")], "k int, v double, d string"), name, ["k"])
    insert_into(spark.createDataFrame([(6, 6.0, "b")], "k int, v double, d string"), name, "append")
    assert found() == sorted([*AFTER, (6, "b", 6.0)])


def test_upsert_adds_rows_whose_key_is_null(spark, disease_table):
    name, found = disease_table
    change = spark.createDataFrame([(None, 7.0, "b"), (None, 8.0, "b"), (1, 0.5, "a")], "k int, v double, d string")
    upsert_into(change, name, ["k"])
    upsert_into(change.filter("k IS NULL").limit(1), name, ["k"])
    assert len(found()) == 4 + 3 and (1, "a", 0.5) in found()

"""Run records, quality records and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sentinela.operators import aggregates
from sentinela.operators.filters import filter_members
from sentinela.operators.nested import explode_quality_tests, normalize_quality_info, parse_json_field
from sentinela.plans import observability
from sentinela.registry.base import Tables, query
from sentinela.sinks.runlog import execution_id


@query("run_duration", """
SELECT event_id, CAST(epoch_us(end_execution) - epoch_us(start_execution) AS DOUBLE) / 1000000.0 AS duration_seconds
FROM v_runs""")
def _(t):
    return observability.with_duration(t.runs).select("event_id", "duration_seconds")


@query("run_metrics", """
SELECT count(*) AS total_runs, CAST(count(*) FILTER (WHERE status = 'success') AS DOUBLE) / count(*) * 100
           AS success_rate,
       count(*) FILTER (WHERE lower(status) = 'error' OR status = 'FAILED') AS errors,
       count(warning_description) AS warnings,
       round(avg(epoch_us(end_execution) - epoch_us(start_execution)) / 1000000.0, 5) AS avg_duration
FROM v_runs""")
def _(t):
    return observability.metrics(t.runs).withColumn("avg_duration", F.round("avg_duration", 5))


@query("success_rate", """
SELECT CAST(count(*) FILTER (WHERE status = 'success') AS DOUBLE) / count(*) * 100 AS success_rate FROM v_runs""")
def _(t):
    return aggregates.success_rate(t.runs, "status", "success")


@query("status_counts", "SELECT status, count(*) AS count FROM v_runs WHERE status IS NOT NULL GROUP BY status")
def _(t):
    return aggregates.value_counts(t.runs, "status")


@query("executions_per_day", """
SELECT CAST(start_execution AS DATE) AS exec_date, count(*) AS count FROM v_runs GROUP BY exec_date""")
def _(t):
    return observability.per_day(t.runs)


@query("logs_filtered", """
SELECT event_id, layer, job_name, status FROM v_runs
WHERE layer IN ('bronze', 'gold') AND job_name IN ('job_1', 'job_2', 'job_5') AND status IN ('success', 'error')""")
def _(t):
    kept = filter_members(t.runs, layer=["bronze", "gold"], job_name=["job_1", "job_2", "job_5"],
                          status=["success", "error"])
    return kept.select("event_id", "layer", "job_name", "status")


@query("recent_runs", """
SELECT event_id, start_execution, job_name, status FROM v_runs WHERE dt_ref >= DATE '2024-04-10' - 90
ORDER BY start_execution DESC, event_id LIMIT 10000""")
def _(t):
    return observability.recent(t.runs, "2024-04-10", limit=10_000).select("event_id", "start_execution", "job_name", "status")


@query("critical_failures", "SELECT event_id, job_name FROM v_runs WHERE critical_table AND status = 'error'")
def _(t):
    return observability.critical_failures(t.runs, failed="error").select("event_id", "job_name")


@query("avg_duration_by_job", """
SELECT job_name, round(avg(epoch_us(end_execution) - epoch_us(start_execution)) / 1000000.0, 5) AS mean
FROM v_runs GROUP BY job_name ORDER BY mean DESC LIMIT 10""")
def _(t):
    return observability.mean_duration_by_job(t.runs).withColumn("mean", F.round("mean", 5))


@query("runs_by_layer", "SELECT layer, count(*) AS count FROM v_runs GROUP BY layer")
def _(t):
    return observability.runs_by_layer(t.runs)


@query("top_failures_status", """
SELECT job_name, count(*) AS failure_count FROM v_runs WHERE status IS DISTINCT FROM 'success'
GROUP BY job_name ORDER BY failure_count DESC, job_name LIMIT 10""")
def _(t):
    return aggregates.top_failures(t.runs, "job_name", success="success")


@query("top_failures_total", "SELECT count(*) AS failure_count FROM v_runs WHERE status IS DISTINCT FROM 'success'")
def _(t):
    return aggregates.top_failures(t.runs, success="success")


@query("top_failures_dq", """
SELECT test_applied, count(*) AS failure_count FROM v_dq_tests WHERE status = 'failure' GROUP BY test_applied""")
def _(t):
    return aggregates.top_failed_tests(t.dq_tests, "test_applied")


@query("dq_failed_columns", """
SELECT column_tested, count(*) AS failure_count FROM v_dq_tests WHERE status = 'failure' GROUP BY column_tested""")
def _(t):
    return observability.failed_columns(t.dq_tests)


@query("dq_status_counts", "SELECT status, count(*) AS count FROM v_dq_tests GROUP BY status")
def _(t):
    return observability.test_status_counts(t.dq_tests)


@query("dq_newest_tests", "SELECT * FROM v_dq_tests WHERE status = 'failure'")
def _(t):
    return observability.newest_tests(t.dq_tests, "failure")


@query("dq_totals", """
SELECT (SELECT count(*) FROM v_runs WHERE layer = 'quality') AS total_runs,
       (SELECT count(info) FROM v_runs WHERE layer = 'quality') AS runs_with_info,
       count(*) FILTER (WHERE status = 'failure') AS failed_tests,
       count(*) FILTER (WHERE status = 'success') AS passed_tests FROM v_dq_tests""")
def _(t):
    return observability.quality_totals(t.runs.filter(F.col("layer") == "quality"), t.dq_tests)


def _quality_runs(t: Tables) -> DataFrame:
    """Runs of the quality layer whose ``info`` holds the tests the way old records kept them."""
    def test(k: int, label: str):
        failed = (F.col("event_id") + k) % 5 == 0
        return F.format_string(
            "{'column_tested': 'col_%d', 'test_applied': '%s', 'status': '%s'}",
            F.lit(k), F.lit(label), F.when(failed, "failure").otherwise("success"))

    info = F.concat(F.lit("{'critical': True, 'rows': None, 'quality_tests': ["),
                    F.concat_ws(", ", test(1, "not null values"), test(2, "unique values"), test(3, "values between")),
                    F.lit("]}"))
    return t.runs.filter(F.col("layer") == "quality").withColumn("info", info)


@query("dq_explode_tests", """
SELECT start_execution, table_name, job_name, column_tested, test_applied, status FROM v_dq_tests""")
def _(t):
    return explode_quality_tests(_quality_runs(t))


@query("parse_json_field", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(t):
    return t.events.select("event_id", parse_json_field(F.col("props"), "k bigint")["k"].alias("k"))


@query("normalize_dq_info", """
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unknown' END AS column_tested,
       CASE WHEN event_type = 'click' THEN 'range' ELSE 'unknown' END AS test_applied,
       CASE event_type WHEN 'view' THEN 'PASSED' WHEN 'click' THEN 'FAILED' ELSE 'UNKNOWN' END AS test_status,
       CASE WHEN event_type = 'click' THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS execution_timestamp,
       CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) END AS value_found
FROM events""")
def _(t):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    day = F.col("ts").cast("date").cast("string")
    view = F.to_json(F.struct(kind.alias("column"), F.lit("passed").alias("status"), user.alias("value")))
    click = F.to_json(F.struct(kind.alias("column_name"), F.lit("range").alias("test"), F.lit("Failed").alias("result"),
                               day.alias("executed_at")))
    info = F.when(kind == "view", view).when(kind == "click", click).when(kind == "error", "not json")
    normal = normalize_quality_info(t.events.withColumn("info", info))
    return normal.select("event_id", "column_tested", "test_applied", "test_status", "execution_timestamp",
                         "value_found")


@query("execution_id", """
SELECT event_id, sha256(job_name || '-' || table_name || '-' || strftime(start_execution, '%Y-%m-%d %H:%M:%S'))
       AS execution_id
FROM v_runs""")
def _(t):
    return t.runs.select("event_id", execution_id(
        F.col("job_name"), F.col("table_name"), F.col("start_execution")).alias("execution_id"))

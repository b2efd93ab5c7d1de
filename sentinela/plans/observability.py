"""Reports on run and quality records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sentinela.functions.dates import seconds_between
from sentinela.functions.numeric import percent_or_zero
from sentinela.operators.aggregates import group_aggregate, top_failed_tests, value_counts


def recent(runs: DataFrame, as_of: str, days: int = 90, limit: int | None = None) -> DataFrame:
    """Runs of the last days, newest first; all of them, or the first ``limit`` of a listing."""
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    newest = runs.filter(F.col("dt_ref") >= since).orderBy(F.col("start_execution").desc_nulls_last(), *_tie(runs))
    return newest.limit(limit) if limit else newest


def _tie(runs: DataFrame) -> list[str]:
    return [c for c in ("event_id", "execution_id") if c in runs.columns]


def with_duration(runs: DataFrame, start: str = "start_execution", end: str = "end_execution") -> DataFrame:
    return runs.withColumn("duration_seconds", seconds_between(F.col(start), F.col(end)))


def metrics(runs: DataFrame) -> DataFrame:
    """Runs, success rate, errors, warnings and mean duration in one pass."""
    status = F.col("status")
    yes = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    return with_duration(runs).agg(
        F.count(F.lit(1)).alias("total_runs"),
        percent_or_zero(yes(status == "success"), F.count(F.lit(1))).alias("success_rate"),
        yes((F.lower(status) == "error") | (status == "FAILED")).alias("errors"),
        F.count("warning_description").alias("warnings"),
        F.avg("duration_seconds").alias("avg_duration"),
    )


def critical_failures(runs: DataFrame, failed: str = "FAILED") -> DataFrame:
    return runs.filter(F.col("critical_table") & (F.col("status") == failed))


def per_day(runs: DataFrame) -> DataFrame:
    return (
        runs.filter(F.col("start_execution").isNotNull()).groupBy(F.col("start_execution").cast("date").alias("exec_date"))
        .agg(F.count(F.lit(1)).alias("count")).orderBy("exec_date")
    )


def mean_duration_by_job(runs: DataFrame, limit: int = 10) -> DataFrame:
    timed = with_duration(runs).filter(F.col("duration_seconds").isNotNull())
    return group_aggregate(timed, ["job_name"], "mean", "duration_seconds", limit=limit)


def runs_by_layer(runs: DataFrame) -> DataFrame:
    return group_aggregate(runs, ["layer"])


def quality_totals(runs: DataFrame, tests: DataFrame) -> DataFrame:
    """Runs, runs with details, failed and passed tests.

    ``tests`` has one row per test; both sides are reduced to one row before they meet.
    """
    run_side = runs.select(F.lit(1).alias("r"), F.col("info").isNotNull().cast("int").alias("i"),
                           F.lit(0).alias("f"), F.lit(0).alias("s"))
    test_side = tests.select(F.lit(0), F.lit(0), (F.col("status") == "failure").cast("int"),
                             (F.col("status") == "success").cast("int"))
    names = {"r": "total_runs", "i": "runs_with_info", "f": "failed_tests", "s": "passed_tests"}
    return run_side.unionAll(test_side).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in names.items()])


def failed_columns(tests: DataFrame, limit: int = 10) -> DataFrame:
    return top_failed_tests(tests, "column_tested", "status", limit)


def test_status_counts(tests: DataFrame) -> DataFrame:
    return value_counts(tests, "status")


def newest_tests(tests: DataFrame, status: str | None = None) -> DataFrame:
    """All test rows, newest run first."""
    chosen = tests.filter(F.col("status") == status) if status else tests
    return chosen.orderBy(F.col("start_execution").desc_nulls_last(), *_tie(tests), "column_tested")

import pytest
from pyspark.sql import functions as F

from sentinela.config import QualitySpec, parse_schema
from sentinela.operators import reconcile
from sentinela.operators.quality import QualityFailure, run_checks, run_suite
from tests.conftest import rows


@pytest.fixture()
def sample(spark):
    return spark.createDataFrame(
        [(1, "a", "2026-01-05", 10.0), (2, "bb", "2026-1-6", -5.0), (2, None, "05/01/2026", 700.0),
         (None, "dddd", None, None), (None, "a,b", "2026-02-30", 50.0)],
        "Id int, name string, day string, price double")


def outcome(df, checks):
    found = run_checks(df, checks, "t").orderBy("position").collect()
    return [(r["column_tested"], r["unexpected_count"], r["status"]) for r in found]


def test_not_null_and_case_insensitive_names(sample):
    assert outcome(sample, {"not_null": {"column": "ID,price"}}) == [("ID", 2, "failure"), ("price", 1, "failure")]


def test_unique_ignores_null_and_counts_rows(sample):
    assert outcome(sample, {"unique_vals": {"column": "id,day,name"}}) == [
        ("id", 2, "failure"), ("day", 0, "success"), ("name", 0, "success")]


def test_date_mask(sample):
    assert outcome(sample, {"date_mask_equal": {"column": "day", "date_mask": "%Y-%m-%d"}}) == [("day", 2, "failure")]


def test_length(sample):
    assert outcome(sample, {"value_length_between": {"column": "name", "min": "1", "max": "3"}}) == [("name", 1, "failure")]


def test_regex_lists_may_hold_commas(sample):
    assert outcome(sample, {"value_match_regex": {"column": ["name"], "regex": ["^[a-d]+(,b)?$"]}}) == [("name", 0, "success")]


def test_between_reports_the_mean_of_all_bad_values(sample):
    got = run_checks(sample, {"values_between": {"column": "price", "min": "0", "max": "100"}}, "t").first()
    assert (got["unexpected_count"], got["mean_unexpected"]) == (2, 347.5)
    assert got["test_applied"] == "values between 0.0 and 100.0"


def test_sets(sample):
    inside = {"column": "id,name", "type": "int,str", "set_values": [["1", "2"], ["a", "bb"]]}
    assert outcome(sample, {"values_to_be_in_set": inside}) == [("id", 0, "success"), ("name", 2, "failure")]
    outside = {"column": "id", "type": "int", "set_values": [[2, 9]]}
    assert outcome(sample, {"values_not_be_in_set": outside}) == [("id", 2, "failure")]


def test_row_count(sample):
    assert outcome(sample, {"df_count_between": {"min": "1", "max": 5}}) == [("Dataset", 0, "success")]
    assert outcome(sample, {"df_count_between": {"min": 6, "max": 9}}) == [("Dataset", 1, "failure")]


def test_order_of_a_mixed_suite(sample):
    got = outcome(sample, {"unique_vals": {"column": "id"}, "not_null": {"column": "name"}, "df_count_between": {"min": 1, "max": 9}})
    assert [g[0] for g in got] == ["id", "name", "Dataset"]


def test_empty_table(spark, sample):
    empty = sample.limit(0)
    assert outcome(empty, {"not_null": {"column": "id"}, "unique_vals": {"column": "id"}}) == [
        ("id", 0, "success"), ("id", 0, "success")]


def test_errors(sample):
    for checks in ({"eval": {}}, {"not_null": {"column": "nope"}}, {},
                   {"value_length_between": {"column": "a,b", "min": "1", "max": "2"}}):
        with pytest.raises((ValueError, KeyError)):
            run_checks(sample, checks, "t")


def test_stop_job(sample):
    checks = {"not_null": {"column": "id"}}
    assert run_suite(sample, QualitySpec("t", checks))[0]["status"] == "failure"
    with pytest.raises(QualityFailure) as raised:
        run_suite(sample, QualitySpec("t", checks, stop_job=True))
    assert raised.value.outcomes[0]["unexpected_count"] == 2


def test_compare_rows_in_both_directions(spark):
    left = spark.createDataFrame([(1, " a"), (1, "a"), (2, None)], "k int, s string")
    right = spark.createDataFrame([("​a ", 1), ("", 2), ("z", 3)], "s string, k int")
    schema = parse_schema({"k": "int", "s": "string"})
    assert rows(reconcile.compare_rows(left, right, schema)) == [(1, 1, "failure")]
    assert rows(reconcile.differing_rows(left, right, schema)) == [(1, "a", 1, 0), (3, "z", 0, 1)]
    assert rows(reconcile.compare_rows(left, left)) == [(0, 0, "success")]


def test_compare_counts(spark):
    assert rows(reconcile.compare_counts(spark.range(3), spark.range(2))) == [(3, 2, "failure")]
    assert rows(reconcile.compare_counts(spark.range(0), spark.range(0))) == [(0, 0, "success")]


def test_compare_metrics(spark):
    left = spark.sql("SELECT 1 AS i, CAST(1.5 AS DECIMAL(10,2)) AS d, DATE '2026-01-01' AS dt, CAST(NULL AS DOUBLE) AS x, "
                     "TIMESTAMP '2026-01-01 10:00:00' AS ts, 'a' AS s")
    right = left.withColumns({"i": F.lit(2), "x": F.lit(0.0)})
    got = {r["metric"]: (r["left_value"], r["right_value"], r["status"]) for r in reconcile.compare_metrics(left, right).collect()}
    assert got["row_count"] == ("1", "1", "success")
    assert got["sum_i"] == ("1", "2", "failure")
    assert got["sum_d"] == ("1.50", "1.50", "success")
    assert got["sum_x"] == (None, "0.00", "success")
    assert got["min_dt"] == ("2026-01-01", "2026-01-01", "success")
    assert got["max_ts"][0] == "2026-01-01 10:00:00"
    assert "sum_s" not in got


def test_metric_sums_of_doubles_do_not_depend_on_the_order(spark):
    """2^53 cents and more: a sum of doubles loses the small values that come after the large one."""
    large, small = spark.sql("SELECT 1e16 AS x"), spark.range(1000).select(F.lit(0.01).alias("x"))
    left, right = large.unionAll(small).coalesce(1), small.unionAll(large).coalesce(1)
    got = {r["metric"]: tuple(r)[1:] for r in reconcile.compare_metrics(left, right).collect()}
    assert got["sum_x"] == ("10000000000000010.00", "10000000000000010.00", "success")


def test_metric_sums_of_doubles_that_no_decimal_holds(spark):
    def total(*values):
        return rows(spark.createDataFrame([(v,) for v in values], "x double").agg(reconcile.metric_columns(
            spark.createDataFrame([], "x double"))["sum_x"]))[0][0]

    assert total(1.0, float("nan")) == "NaN"
    assert total(1.0, float("inf")) == "Infinity"
    assert total(1e30, None, 1e30) == f"{2 * 10**30}.00"
    assert total(9e25, 9e25) == f"{18 * 10**25}.00"
    assert total(None) is None
    assert total(0.125, 0.0, -1.005) == "-0.88"


def test_suite_with_comparisons(spark, sample):
    sample.createOrReplaceTempView("ours")
    spec = QualitySpec("t", {
        "compare_count_df_with_db": {"db_query": "all"}, "not_null": {"column": "day"},
        "compare_df_with_df_db": {"db_query": "all", "schema": {"Id": "int", "name": "string"}},
        "general_metrics_athena_db": {"athena_tables": "ours,ours", "db_tables": "a,b"}})
    asked = []

    def counterpart(params):
        asked.append(params.get("db_table", params.get("db_query")))
        return sample.filter("price > 0") if asked[-1] == "b" else sample

    got = [(o["column_tested"], o["unexpected_count"], o["status"]) for o in run_suite(sample, spec, counterpart)]
    assert got[:3] == [("day", 1, "failure"), ("Dataset", 0, "success"), ("Dataset", 0, "success")]
    assert ("ours.row_count", 1, "failure") in got and got.count(("ours.sum_price", 0, "success")) == 1
    assert asked == ["all", "all", "a", "b"]
    with pytest.raises(ValueError, match="counterpart"):
        run_suite(sample, spec)

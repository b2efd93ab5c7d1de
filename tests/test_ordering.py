import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from sentinela.operators.filters import at_latest
from sentinela.operators.ordering import exact_percentiles, in_pieces, latest_per_key, rank_descending
from sentinela.staging import stage
from tests.conftest import rows


def test_latest_per_key_breaks_ties(spark):
    df = spark.createDataFrame([(1, 2020, 5), (1, 2021, 3), (1, 2021, 9), (2, None, 4), (3, 2019, None)],
                               "k int, y int, v int")
    assert rows(latest_per_key(df, ["k"], ["y"], ["y", "v"])) == [(1, 2021, 9), (2, None, 4), (3, 2019, None)]


def _ranked_like_a_window(spark, data, buckets):
    df = stage(spark.createDataFrame(data, "id int, g string, h string, v double"), "t")
    got = rank_descending(df, "v", ["g"], {"r": [], "rh": ["h"]}, salt_on=["id"], buckets=buckets)
    small = rank_descending(df, "v", ["g"], {"r": [], "rh": ["h"]}, salt_on=["id"])
    order = F.col("v").desc_nulls_last()
    want = df.withColumns({"r": F.rank().over(Window.partitionBy("g").orderBy(order)).cast("bigint"),
                           "rh": F.rank().over(Window.partitionBy("g", "h").orderBy(order)).cast("bigint")})
    assert rows(got, "id", "r", "rh") == rows(want, "id", "r", "rh") == rows(small, "id", "r", "rh")


@pytest.mark.parametrize("buckets", [2, 4, 128])
def test_rank_equals_the_window(spark, buckets):
    rng = random.Random(buckets)
    data = []
    for i in range(3000):
        g = rng.choice(["a", "a", "b", None])
        # A third of the rows share one value, others tie now and then, some are unknown.
        v = rng.choice([7.5, float(rng.randint(0, 50)), rng.random() * 100, None])
        data.append((i, g, rng.choice(["x", "y", None]), v))
    _ranked_like_a_window(spark, data, buckets)


def test_rank_of_unknown_and_equal_values(spark):
    _ranked_like_a_window(spark, [(i, "a", "x", None) for i in range(50)], 8)
    _ranked_like_a_window(spark, [(i, "a", "x", 1.0) for i in range(50)], 8)


@pytest.mark.parametrize("buckets, leaf", [(2, 1), (4, 3), (16, 50), (128, 600), (128, 2_000_000)])
def test_exact_percentiles_equal_numpy(spark, buckets, leaf):
    rng = random.Random(leaf)
    values = [rng.choice([3.25, float(rng.randint(0, 9)), rng.gauss(0, 40)]) for _ in range(701)]
    df = stage(spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double"), "t")
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p100": 1.0}
    got = exact_percentiles(df, "x", wanted, buckets, leaf).first()
    for name, p in wanted.items():
        assert got[name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_percentiles_of_nothing_and_of_one(spark):
    assert exact_percentiles(spark.sql("SELECT CAST(NULL AS DOUBLE) AS x"), "x", {"p": 0.5}).first()[0] is None
    assert exact_percentiles(spark.sql("SELECT 4 AS x"), "x", {"p": 0.5}).first()[0] == 4.0
    assert exact_percentiles(spark.sql("SELECT 4 AS x"), "x", {"p": 0.5}).first()[0] == 4.0
    nothing = spark.sql("SELECT CAST(NULL AS DOUBLE) AS x")
    assert exact_percentiles(nothing, "x", {"p": 0.5}).first()[0] is None


def test_at_latest_scope(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5)], "d string, w int")
    assert rows(at_latest(df, "w")) == [("b", 5)]
    assert rows(at_latest(df, "w", F.col("d") == "a")) == [("a", 3)]


def test_latest_per_key_of_many_columns_is_the_struct_maximum(spark):
    rng = random.Random(4)
    data = [(rng.randint(0, 40), *[rng.choice([None, 0, 1, 2]) for _ in range(3)], rng.choice([None, 0.5, float("nan")]))
            for _ in range(600)]
    df = spark.createDataFrame(data, "k int, a int, b bigint, c int, d double")
    got = latest_per_key(df, ["k"], ["a", "b"], ["d", "c", "a"])
    want = df.groupBy("k").agg(F.max(F.struct("a", "b", "d", "c")).alias("w")).select("k", "w.d", "w.c", "w.a")
    assert got.columns == want.columns and list(map(str, rows(got))) == list(map(str, rows(want)))
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    named = df.withColumn("t", F.col("c").cast("string"))
    assert rows(latest_per_key(named, ["k"], ["a"], ["t"])) == rows(
        named.groupBy("k").agg(F.max(F.struct("a", "t")).alias("w")).select("k", "w.t"))


def test_pieces_follow_the_data_and_ties_are_split(spark):
    # One group of 100 times the others, a third of its rows at one value.
    data = [(i, "big", "x", 5.0 if i % 3 == 0 else float(i)) for i in range(40_000)]
    data += [(40_000 + i, f"g{i % 20}", "x", float(i % 7)) for i in range(8_000)]
    df = stage(spark.createDataFrame(data, "id int, g string, h string, v double"), "t")
    sizes = [r["count"] for r in in_pieces(df, "v", ["g"], ["id"], 24).groupBy("_piece").count().collect()]
    assert len(sizes) == 24 and max(sizes) < 2 * 48_000 / 24
    tied = in_pieces(df, "v", ["g"], ["id"], 24).filter("g = 'big' AND v = 5.0").select("_piece").distinct().count()
    assert tied > 5
    got = rank_descending(df, "v", ["g"], {"r": []}, salt_on=["id"], buckets=24)
    window = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last())
    assert rows(got, "id", "r") == rows(df.withColumn("r", F.rank().over(window).cast("bigint")), "id", "r")

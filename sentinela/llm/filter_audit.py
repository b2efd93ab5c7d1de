"""What each of several filters takes in every order of applying them, and what it is worth on average.

A filter takes a row or not whatever ran before it, so the rows that a set S of filters removes,
v(S), tell everything: filter i after the set S removes v(S + i) - v(S). All coalitions (32 for five
filters) are tabulated by one aggregation, and orders never touch a row.

The Shapley values are an exact constrained least squares fit: of all f with sum f = v(all), they
minimise the sum over S of w(S) (v(S) - sum of f over S)^2, with the kernel weights
w(S) = (m - 1) / (C(m, |S|) |S| (m - |S|)). The normal equations with the constraint's multiplier do not depend
on the counts, so they are solved once in rationals for all right sides; the solution is a row of
whole weights a filter for m! times its value, which is the filter's removals summed over all m! orders.

Defined cases: a null text counts as empty; a null part is the empty string and forms one part with
it; a row whose id is null is no copy of any other and none of it; rows with the same smallest id are
no copies of each other; rows that share an id each count; several labels of an id count as one, 1 if any is.
An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, functions as F

from sentinela.llm.tables import text_or_empty
from sentinela.staging import stage

# Rows with a null id meet no label; they are spread by text instead of all going where null goes.
SPREAD = 1024


def coalition_weights(m: int) -> list[list[int]]:
    """For each of m players the weight of every coalition (a number of m bits) in m! times its Shapley value."""
    coalitions, everyone = range(1 << m), (1 << m) - 1
    inner = [s for s in coalitions if 0 < s < everyone]
    kernel = {s: Fraction(m - 1, comb(m, k) * k * (m - k)) for s in inner if (k := s.bit_count())}
    # Rows: one normal equation a player and the constraint. Columns: m values, the multiplier, one right side a coalition.
    rows = []
    for i in range(m):
        has = [s for s in inner if s >> i & 1]
        left = [sum((kernel[s] for s in has if s >> j & 1), Fraction(0)) for j in range(m)]
        rows.append(left + [Fraction(1)] + [kernel[s] if s in has else Fraction(0) for s in coalitions])
    rows.append([Fraction(1)] * m + [Fraction(0)] + [Fraction(int(s == everyone)) for s in coalitions])
    for i in range(m + 1):
        pivot = next(r for r in range(i, m + 1) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(m + 1):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    solved = [[x * factorial(m) for x in row[m + 1:]] for row in rows[:m]]
    if any(x.denominator != 1 for row in solved for x in row):
        raise ArithmeticError("the normal equations have no whole solution")
    return [[int(x) for x in row] for row in solved]


def _bits(conditions: dict[str, Column]) -> Column:
    """The failed filters of a row as a number, the first filter in the lowest bit; null conditions are not failed."""
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0)).cast("int")


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions of the filters that look at nothing but a text."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": F.regexp_like(text, F.lit(r"[#$%&*|]")),
    }


def marked(docs: DataFrame, part: str, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``part, failed, good, toxic`` of each row: the filters it fails and its labels, 0 where it has none.

    Texts are read once and leave as digests. The last filter fails for texts that a row with a
    smaller id has as well: the smallest id of each digest, a maximum that combines before the
    shuffle, is joined to its own row by digest and id, so that no task gets all copies of a text.
    """
    whole = text_or_empty(text)
    rows = stage(docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("digest"), _bits(text_failures(whole)).alias("bits"),
    ), "audited")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("id").isNotNull()
    rows = rows.join(first, ["digest", "id"], "left").select(
        "id", "part", (F.col("bits") + F.when(copy, 1 << len(text_failures(whole))).otherwise(0)).alias("failed"),
        F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD)) + 1).otherwise(0).alias("spread"),
    )
    told = labels.groupBy(F.col(doc_id).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    ).withColumn("spread", F.lit(0).cast("long"))
    return rows.join(told, ["id", "spread"], "left").select(
        "part", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def audit(rows: DataFrame, letters: str) -> DataFrame:
    """One row a part, order of the filters and step, from ``part, failed, good, toxic`` (see ``marked``).

    The k-th letter stands for bit k of ``failed``. Columns are ``part``, ``filter_order``, ``step`` and the counts
    ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.
    """
    m = len(letters)
    everyone = (1 << m) - 1
    tallies = rows.groupBy("part", "failed").agg(
        F.count("*").alias("n"), F.sum("good").alias("n_good"), F.sum("toxic").alias("n_toxic"))

    def by_coalition(n: str) -> Column:
        caught = [F.sum(F.when(F.col("failed").bitwiseAND(s) != 0, F.col(n)).otherwise(0)) for s in range(1 << m)]
        return F.array(*caught)

    table = tallies.groupBy("part").agg(
        F.sum("n").alias("rows"), by_coalition("n").alias("v"), by_coalition("n_good").alias("v_good"),
        by_coalition("n_toxic").alias("v_toxic"))
    values = F.array(*[
        sum((w * F.get("v", F.lit(s)) for s, w in enumerate(weights) if w), F.lit(0).cast("long"))
        for weights in coalition_weights(m)])
    table = table.withColumn("values", values)

    orders = ["".join(p) for p in permutations(letters)]
    steps = table.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(m))))
    places = [F.instr("filter_order", c) for c in letters]
    before = sum((F.when(p < F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(places)), F.lit(0))
    player = sum((F.when(p == F.col("step"), i).otherwise(0) for i, p in enumerate(places)), F.lit(0))
    steps = steps.withColumns({"before": before, "player": player})
    steps = steps.withColumn("bit", F.element_at(F.array(*[F.lit(1 << i) for i in range(m)]), F.col("player") + 1))
    after = F.col("before") + F.col("bit")

    def gained(v: str) -> Column:
        return F.get(v, after) - F.get(v, F.col("before"))

    return steps.select(
        "part", "filter_order", "step",
        (F.col("rows") - F.get("v", after)).alias("kept"),
        gained("v").alias("removed"),
        (F.get("v", F.col("bit")) - gained("v")).alias("redundant"),
        (F.get("v", F.lit(everyone)) - F.get("v", everyone - F.col("bit"))).alias("unique_fails"),
        gained("v_good").alias("good_lost"),
        gained("v_toxic").alias("toxic_lost"),
        F.get("values", F.col("player")).alias("shapley"),
    )

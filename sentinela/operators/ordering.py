"""Ranks, latest rows and exact percentiles that never sort a whole group in one task.

Ranks come from one range exchange over group and falling value: its partitions are the pieces of a
group, as many as the data needs, and rows that tie are spread over pieces by a hash. Ranks inside a piece and
the sizes of the pieces before it make the rank in the group, exactly, whatever the pieces are.

Percentiles cut a value range with approximate quantiles, count the parts exactly and order only the
parts that hold a wanted position. A value that is itself a cut point (as any very frequent value
is) is a part of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentinela.staging import stage

BUCKETS = 128
LEAF_ROWS = 2_000_000
# Types whose values an aggregation updates in place, so that hashing does without a sort.
FIXED_WIDTH = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row with the largest ``order`` per key, ties broken by the kept values; NULL is the smallest.

    The largest values of the last column for each value of those before it, then of the last but one,
    and so on: hash aggregations of fixed-width buffers, which combine before they shuffle. Where a column
    is text, whose largest value has no such buffer, one maximum over a struct does the same by sorting.
    """
    columns = [*order, *[c for c in keep if c not in order]]
    types = dict(df.dtypes)
    if any(types[c] not in FIXED_WIDTH for c in columns):
        winner = df.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_winner"))
        return winner.select(*keys, *[F.col(f"_winner.{c}").alias(c) for c in keep])
    rows = df.select(*keys, *columns)
    for i in reversed(range(len(columns))):
        column, later = columns[i], columns[i + 1:]
        # One row for each value of the columns up to this one; the later ones follow the largest.
        most = F.max(column)
        rows = rows.groupBy(*keys, *columns[:i]).agg(most.alias(column), *[
            F.when(most.isNull(), F.max(F.when(F.col(column).isNull(), F.col(c)))).otherwise(F.max_by(c, column)).alias(c)
            for c in later])
    return rows.select(*keys, *keep)


def _cut_points(value: Column, buckets: int) -> Column:
    """At most ``buckets - 1`` distinct values of the column, largest first."""
    fractions = [i / buckets for i in range(1, buckets)]
    return F.sort_array(F.array_distinct(F.percentile_approx(value, fractions, 20 * buckets)), asc=False)


def _bucket_below(value: Column, cuts: Column, buckets: int) -> Column:
    """Bucket number, growing as the value falls: 2n between cut points, 2n+1 on one.

    n counts the cut points above the value, found by halving steps.
    """
    steps = F.array(*[F.lit(2 ** k) for k in reversed(range(buckets.bit_length()))])
    return F.when(value.isNotNull(), F.aggregate(
        steps, F.lit(0),
        lambda above, step: F.when(F.get(cuts, above + step - 1) > value, above + step).otherwise(above),
        lambda above: above * 2 + F.coalesce(F.get(cuts, above) == value, F.lit(False)).cast("int"),
    ))


def in_pieces(df: DataFrame, value: str, groups: list[str], salt_on: list[str], pieces: int | None = None) -> DataFrame:
    """``df`` range-partitioned by group and falling value, with the partition's number as ``_piece``.

    How many pieces there are follows the data (AQE joins small neighbours) unless ``pieces`` says it. Equal
    values are ordered by a hash of ``salt_on``, so that a value which many rows share goes over several pieces.
    """
    keys = [*[F.col(g).asc() for g in groups], F.col(value).desc_nulls_last(), F.xxhash64(*salt_on).asc()]
    ranged = df.repartitionByRange(pieces, *keys) if pieces else df.repartitionByRange(*keys)
    return ranged.withColumn("_piece", F.spark_partition_id())


def rank_descending(
    df: DataFrame,
    value: str,
    groups: list[str],
    ranks: dict[str, list[str]],
    salt_on: list[str],
    buckets: int | None = None,
) -> DataFrame:
    """Add ``RANK() OVER (PARTITION BY groups [+ more] ORDER BY value DESC NULLS LAST)`` columns.

    ``ranks`` maps each output column to the columns that partition it beyond ``groups``; one range
    exchange serves them all, in ``buckets`` pieces if given. Rows with their ranks inside a piece are staged
    once; the sizes of the pieces, one small row each, are counted from there.
    """
    local = in_pieces(df, value, groups, salt_on, buckets)
    for output, more in ranks.items():
        inside = Window.partitionBy("_piece", *groups, *more).orderBy(F.col(value).desc_nulls_last())
        local = local.withColumn(output, F.rank().over(inside))
    local = stage(local, "ranks-in-pieces")
    for output, more in ranks.items():
        keys = [*groups, *more]
        before = stage(_before_pieces(local, value, keys, output), "before-pieces")
        tied = F.when(F.col(value).eqNullSafe(F.col("_first")), F.col("_tied")).otherwise(0)
        local = (
            local.join(before.withColumnsRenamed({k: f"_{k}" for k in keys}).withColumnRenamed("_piece", "__piece"),
                       _renamed_match([*keys, "_piece"]), "left")
            .withColumn(output, (F.col(output) + F.col("_rows") - tied).cast("bigint"))
            .drop("_first", "_rows", "_tied", *[f"_{k}" for k in [*keys, "_piece"]])
        )
    return local.drop("_piece")


def _before_pieces(local: DataFrame, value: str, keys: list[str], rank: str) -> DataFrame:
    """For each piece of a group the rows in pieces before it, and how many of these tie with its first value.

    Of a piece, only the first value can occur in earlier ones, and only as their last value.
    """
    sizes = local.groupBy(*keys, "_piece").agg(
        F.count("*").alias("n"), F.max(value).alias("_first"), F.max(rank).alias("at_last"),
        F.when(F.count(value) == F.count("*"), F.min(value)).alias("last"),
    ).withColumn("ties", F.col("n") - F.col("at_last") + 1)
    so_far = Window.partitionBy(*keys, "last").orderBy("_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_order = Window.partitionBy(*keys).orderBy("_piece")
    sizes = sizes.withColumn("_last", F.struct("last", F.sum("ties").over(so_far).alias("ties")))
    sizes = sizes.withColumn("_before", F.lag("_last").over(in_order)).withColumn(
        "_rows", F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = F.col("_before").isNotNull() & F.col("_before.last").eqNullSafe(F.col("_first"))
    return sizes.select(*keys, "_piece", "_first", "_rows", F.when(same, F.col("_before.ties")).otherwise(0).alias("_tied"))


def _renamed_match(names: list[str]) -> Column:
    condition = None
    for name in names:
        same = F.col(name).eqNullSafe(F.col(f"_{name}"))
        condition = same if condition is None else condition & same
    return condition


def exact_percentiles(
    df: DataFrame,
    value: str,
    percentiles: dict[str, float],
    buckets: int = BUCKETS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """One row of exact, linearly interpolated percentiles; NULL and NaN are left out.

    The built-in aggregate would keep every distinct value in one buffer. Here the value range is
    cut until every wanted position lies on a cut point or in a piece of at most ``leaf_rows``
    rows, and only those pieces are ordered.
    A pass brings back at most ``buckets`` cut points and twice as many counts, whatever the
    size of the data; ``df`` should be a table or a staged one, since each pass reads it again.
    """
    number = F.col(value).cast("double")
    numbers = df.select(number.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    pieces = _pieces(numbers, None, None, 0, buckets)
    total = pieces[-1].start + pieces[-1].rows if pieces else 0
    if total == 0:
        return df.agg(*[F.max(F.lit(None).cast("double")).alias(name) for name in percentiles])

    places = {name: p * (total - 1) for name, p in percentiles.items()}
    wanted = sorted({edge for at in places.values() for edge in (math.floor(at), math.ceil(at))})
    leaves: set[_Piece] = set()
    split: dict[_Piece, list[_Piece]] = {}
    for position in wanted:
        around = pieces
        while True:
            piece = next(x for x in around if x.start <= position < x.start + x.rows)
            if piece.exact is not None or piece.rows <= leaf_rows:
                break
            if piece not in split:
                split[piece] = _pieces(numbers, piece.low, piece.high, piece.start, buckets)
            around = split[piece]
        leaves.add(piece)
    return _pick(numbers, places, leaves)


@dataclass(frozen=True)
class _Piece:
    """Rows strictly between two cut points, or equal to one, and how many rows come before."""

    low: float | None
    high: float | None
    exact: float | None
    start: int
    rows: int

    def holds(self, v: Column) -> Column:
        if self.exact is not None:
            return v == self.exact
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & (v > self.low)
        return inside if self.high is None else inside & (v < self.high)


def _pieces(numbers: DataFrame, low: float | None, high: float | None, start: int, buckets: int) -> list[_Piece]:
    part = numbers.filter(_Piece(low, high, None, 0, 0).holds(F.col("_v")))
    cuts = part.agg(_cut_points(F.col("_v"), buckets)).first()[0]
    if not cuts:
        return []
    points = F.array(*[F.lit(c) for c in cuts])
    counts = dict(part.groupBy(_bucket_below(F.col("_v"), points, buckets)).agg(F.count(F.lit(1))).collect())
    cuts = cuts[::-1]
    found = []
    for i in range(len(cuts) + 1):
        left, right = (cuts[i - 1] if i else low), (cuts[i] if i < len(cuts) else high)
        for exact, bucket in ((None, 2 * (len(cuts) - i)), (right, 2 * (len(cuts) - i) - 1)):
            if bucket in counts:
                found.append(_Piece(left, right, exact, start, counts[bucket]))
                start += counts[bucket]
    return found


def _pick(numbers: DataFrame, places: dict[str, float], leaves: set[_Piece]) -> DataFrame:
    """Order the leaf pieces inside and interpolate between the wanted positions."""
    distinct = sorted(leaves, key=lambda x: x.start)
    which, wanted = None, F.lit(False)
    for i, piece in enumerate(distinct):
        here = piece.holds(F.col("_v"))
        wanted = wanted | here
        which = F.when(here, i) if which is None else which.when(here, i)
    starts = F.create_map(*[F.lit(x) for i, piece in enumerate(distinct) for x in (i, piece.start)])
    inside = Window.partitionBy("_leaf").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        numbers.filter(wanted).withColumn("_leaf", which)
        .groupBy("_leaf", "_v").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_to", F.element_at(starts, F.col("_leaf")) + F.sum("_n").over(inside))
    )

    def at(position: int) -> Column:
        hit = (F.col("_to") - F.col("_n") <= position) & (F.lit(position) < F.col("_to"))
        return F.max(F.when(hit, F.col("_v")))

    out = []
    for name, place in places.items():
        low, high = at(math.floor(place)), at(math.ceil(place))
        out.append((low + (high - low) * F.lit(place - math.floor(place))).alias(name))
    return placed.agg(*out)

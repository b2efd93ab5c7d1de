"""SimHash near-duplicates, linked through vantage-point trees.

Two fingerprints within three bits differ in at most one bit of their lower or of their upper
half. Each half is therefore searched with a radius of one bit, in a tree of its own: a node
holds a vantage point and a distance that cuts its points in two, a search takes a side only
where the triangle bound allows a point within the radius. The upper levels of both trees come
from a bounded sample and cut all fingerprints into shards; a fingerprint is stored in one shard
of each tree and asked in every shard whose border it may reach across. Inside a shard the same
search goes on down to small blocks, and each candidate pair is checked on all 64 bits.

A shard reports a spanning forest, never all pairs. Shards larger than a block are searched as
several blocks of stored points, so a dense group of near copies makes more tasks, not larger ones.

Defined cases: a null or blank text has fingerprint zero and links like any other; equal
fingerprints always share a component; a null id never becomes a component's id unless the
component has no other; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sentinela.llm.tables import text_or_empty
from sentinela.staging import stage

MOST_BITS = 3
# One half of two linked fingerprints differs in at most this many bits.
HALF_BITS = MOST_BITS // 2
# Fingerprints that fit the shard trees, and stored points of a shard that are searched in one task.
SAMPLE, SHARD, BLOCK = 32_768, 50_000, 200_000
# Pairs compared at once, and points below which a block is not cut further.
PAIRS_AT_ONCE, LEAF = 1 << 21, 256
SHINGLES_AT_ONCE = 1 << 18


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    """Bits set in more than half of the hashes of all word shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1], ends[size - 1:]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), SHINGLES_AT_ONCE):
        part = slice(i, i + SHINGLES_AT_ONCE)
        bounds = zip(starts[part].tolist(), ends[part].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in bounds], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))

    return F.pandas_udf(run, "long")(text)


def _half(points: np.ndarray, half: int) -> np.ndarray:
    return (points >> np.uint64(32 * half)).astype(np.uint32)


def _cut(halves: np.ndarray, random: np.random.Generator) -> tuple[int, int] | None:
    """Vantage point and distance that part these points most evenly, least of them near the border.

    None where a cut would leave most points on both sides, as within a group of near copies.
    """
    best = None
    for vantage in random.choice(halves, 4):
        at = np.bincount(np.bitwise_count(halves ^ vantage), minlength=33)
        inside = np.cumsum(at)
        reach_in = np.r_[inside[HALF_BITS:], [inside[-1]] * HALF_BITS]
        reach_out = len(halves) - np.r_[[0] * HALF_BITS, inside[: 33 - HALF_BITS]]
        cost = np.maximum(inside, len(halves) - inside) + 0.5 * (reach_in + reach_out)
        t = int(np.argmin(cost[:32]))
        if max(reach_in[t], reach_out[t]) < 0.9 * len(halves) and (best is None or cost[t] < best[0]):
            best = cost[t], int(vantage), t
    return best and best[1:]


def shard_trees(sample: np.ndarray, share: int) -> list[list[tuple]]:
    """For each half, nodes ``(vantage, distance, inside, outside)`` or ``(shard,)``; at most ``share`` samples a shard."""
    trees, shards, random = [], 0, np.random.default_rng(7)
    for half in (0, 1):
        nodes: list[tuple] = [()]
        todo = [(0, _half(sample, half))]
        while todo:
            i, points = todo.pop()
            cut = _cut(points, random) if len(points) > share else None
            if cut is None:
                nodes[i] = (shards,)
                shards += 1
                continue
            near = np.bitwise_count(points ^ np.uint32(cut[0])) <= cut[1]
            nodes[i] = (*cut, len(nodes), len(nodes) + 1)
            todo += [(len(nodes), points[near]), (len(nodes) + 1, points[~near])]
            nodes += [(), ()]
        trees.append(nodes)
    return trees


def route(points: np.ndarray, trees: list[list[tuple]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard, the points asked there, and which of them are stored there."""
    for half, nodes in enumerate(trees):
        halves = _half(points, half)
        todo = [(0, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            i, here, home = todo.pop()
            if not len(here):
                continue
            if len(nodes[i]) == 1:
                yield nodes[i][0], here, home
                continue
            vantage, t, inside, outside = nodes[i]
            d = np.bitwise_count(halves[here] ^ np.uint32(vantage)).astype(np.int16)
            into, out = d - HALF_BITS <= t, d + HALF_BITS > t
            todo += [(inside, here[into], (home & (d <= t))[into]), (outside, here[out], (home & (d > t))[out])]


class Forest:
    """Union-find over the points of a shard."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)

    def roots(self, items: np.ndarray) -> np.ndarray:
        return np.array([self.root(i) for i in items.tolist()], np.int64)


def link(points: np.ndarray, home: np.ndarray, half: int, asks: np.ndarray | None = None) -> Forest:
    """Join the points that ask, all if not said, to the stored points within ``MOST_BITS`` that are near in this half."""
    forest, random, halves = Forest(len(points)), np.random.default_rng(11), _half(points, half)
    todo = [(np.flatnonzero(home), np.arange(len(points)) if asks is None else np.flatnonzero(asks))]
    while todo:
        stored, asked = todo.pop()
        if not len(stored) or not len(asked):
            continue
        cut = _cut(halves[stored], random) if len(stored) > LEAF else None
        if cut is None:
            _compare(points, stored, asked, forest)
            continue
        of_stored, of_asked = (np.bitwise_count(halves[x] ^ np.uint32(cut[0])).astype(np.int16) for x in (stored, asked))
        todo.append((stored[of_stored <= cut[1]], asked[of_asked - HALF_BITS <= cut[1]]))
        todo.append((stored[of_stored > cut[1]], asked[of_asked + HALF_BITS > cut[1]]))
    return forest


def _compare(points: np.ndarray, stored: np.ndarray, asked: np.ndarray, forest: Forest) -> None:
    step = max(1, PAIRS_AT_ONCE // len(stored))
    for i in range(0, len(asked), step):
        rows = asked[i:i + step]
        near = np.bitwise_count(points[rows][:, None] ^ points[stored][None, :]) <= MOST_BITS
        near &= rows[:, None] != stored[None, :]
        # One link of each row and column first; what these leave apart is joined in further rounds.
        while near.any():
            linked, hit = near.any(axis=1), near.any(axis=0)
            forest.join(rows[linked], stored[near.argmax(axis=1)[linked]])
            forest.join(stored[hit], rows[near.argmax(axis=0)[hit]])
            near &= forest.roots(rows)[:, None] != forest.roots(stored)[None, :]


def dealt(placed: DataFrame) -> DataFrame:
    """Groups ``shard, i, j`` of fingerprints, each with whether it is stored (``home``) or asked (``asks``) there.

    A shard's stored points and those asked there are dealt over as many blocks as they need; each block of the one
    meets each of the other, so no group holds more than about two blocks, however many points share a half.
    """
    blocks = placed.groupBy("shard").agg(
        F.ceil(F.count_if("home") / BLOCK).cast("int").alias("rows"), F.ceil(F.count("*") / BLOCK).cast("int").alias("columns"))
    own = F.pmod(F.hash("fp"), F.col("rows")).alias("row"), F.pmod(F.hash(F.lit(1), "fp"), F.col("columns")).alias("column")
    rows = placed.join(blocks.where("rows > 0"), "shard").select("*", *own)
    # As a stored point to all columns of its row, as an asked one to all rows of its column.
    places = F.array_distinct(F.concat(
        F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.struct(
            F.col("row").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i: int, j: int>>")),
        F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), F.col("column").alias("j")))))
    return rows.select("shard", "fp", "home", "row", "column", F.explode(places).alias("at")).select(
        "shard", "at.i", "at.j", "fp", (F.col("home") & (F.col("row") == F.col("at.i"))).alias("home"),
        (F.col("column") == F.col("at.j")).alias("asks"))


def _links(points: DataFrame) -> DataFrame:
    """Edges ``a > b`` between fingerprints that connect all that are within ``MOST_BITS``."""
    spark = points.sparkSession
    total = points.count()
    if total == 0:
        return spark.createDataFrame([], "a long, b long")
    # A sample by hash, bounded whatever the table holds.
    every = max(1, total // SAMPLE)
    sample = points.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").limit(2 * SAMPLE)
    values = np.array([r.fp for r in sample.collect()], np.int64).view(np.uint64)
    trees = shard_trees(np.sort(values), max(8, SHARD // every))
    first_of_upper = min((n[0] for n in trees[1] if len(n) == 1), default=0)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            for shard, here, home in route(fps.view(np.uint64), trees):
                yield pd.DataFrame({"shard": np.int32(shard), "fp": fps[here], "home": home})

    placed = stage(points.select("fp").mapInPandas(place, "shard int, fp long, home boolean"), "simhash-shards")
    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(group["fp"].to_numpy(np.int64))
        fps, home, asks = (group[c].to_numpy()[order] for c in ("fp", "home", "asks"))
        forest = link(fps.view(np.uint64), home, int(key[0] >= first_of_upper), asks)
        root = forest.roots(np.arange(len(fps)))
        tied = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[tied], "b": fps[root[tied]]})

    return dealt(placed).groupBy("shard", "i", "j").applyInPandas(search, "a long, b long")


def connect(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the edges ``a > b``, by alternating large and small stars.

    Each round is written to the shared folder; minima combine before they are shuffled, and the
    joins back are plain ones, which Spark splits where one node has very many edges.
    """
    edges = stage(edges.distinct(), "stars")
    last = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        )).alias("e")).select("e.a", "e.b").where("a > b").distinct()
        edges = stage(small, "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state


def _rooted(points: DataFrame) -> DataFrame:
    """``fp``, ``least`` and the ``root`` of each point's component."""
    points = stage(points, "simhash-points")
    roots = connect(_links(points))
    rooted = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return stage(rooted, "simhash-roots")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a long) and ``component_id`` of every row."""
    docs = stage(df.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprints(text_or_empty(text)).alias("fp")), "simhash")
    rooted = _rooted(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    components = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_point = rooted.join(components, "root").select("fp", "component_id")
    return docs.join(of_point, "fp").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each component: that of the smallest id, null last, and of these that of the least text hash.

    Rows are numbered as they are written, so ids need not tell them apart. Minima combine before
    they are shuffled; texts are shuffled once, by row number, which no two rows share.
    """
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    rows = stage(numbered.select(
        "*", F.xxhash64(text_or_empty(text)).alias("__hash"), fingerprints(text_or_empty(text)).alias("__fp")), "simhash-rows")
    order = F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"), "__hash", "__row")
    rooted = _rooted(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(order).alias("least")))
    stays = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.__row")
    return rows.join(stays, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])

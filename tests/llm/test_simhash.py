import re

import numpy as np
import xxhash

from pyspark.sql import functions as F

from sentinela.llm import simhash
from sentinela.llm.queries import QUERIES
from tests.conftest import rows

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Component (smallest id) of each id, by comparing all pairs."""
    ids = sorted(prints)
    fps = np.array([prints[i] for i in ids], np.uint64)
    least = np.array(ids)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    while True:
        new = np.where(near, least[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == least).all():
            return dict(zip(ids, least.tolist()))
        least = new


def test_fingerprint_is_the_plain_one():
    for text in ("", " \t", "One", "One two", "ÀB c\x0bD é", "a b c a b c a b c", "x\xa0y z w"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_query_is_as_by_all_pairs(spark):
    got = QUERIES["op8_simhash_vantage_trees"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    parts = plain_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{prints[i]:016x}", parts[i]) for i in prints
    }


def points_with_groups(n=6000):
    """Random points, pairs at 1 to 4 bits, a chain, and a dense group."""
    random = np.random.default_rng(3)
    base = random.integers(0, 2**64, n, np.uint64)
    flips = [base[:600].copy()]
    for bits in (1, 2, 3, 4):
        near = base[bits * 100:bits * 100 + 80].copy()
        for _ in range(bits):
            near ^= np.uint64(1) << random.integers(0, 64, len(near), np.uint64)
        flips.append(near)
    chain = [base[0]]
    for _ in range(200):
        for _ in range(3):
            chain.append(chain[-1] ^ (np.uint64(1) << random.integers(0, 64, dtype=np.uint64)))
    dense = np.full(3000, base[1])
    for _ in range(3):
        dense ^= np.uint64(1) << random.integers(0, 64, len(dense), np.uint64)
    return np.unique(np.concatenate([base, *flips, np.array(chain[::3]), dense]))


def test_shards_and_trees_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 2000)
    monkeypatch.setattr(simhash, "SHARD", 300)
    monkeypatch.setattr(simhash, "BLOCK", 200)
    fps = points_with_groups()
    signed = fps.view(np.int64).tolist()
    points = spark.createDataFrame([(f, f) for f in signed], "fp long, least long")
    found = {r.node: r.root for r in simhash.connect(simhash._links(points)).collect()}
    parts = plain_components(dict(zip(signed, fps)))
    mine = {}
    for f in signed:
        mine.setdefault(found.get(f, f), set()).add(f)
    theirs = {}
    for f in signed:
        theirs.setdefault(parts[f], set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_odd_rows(spark):
    long_text = "alpha beta " * 50_000
    docs = spark.createDataFrame(
        [(1, None, 9, "x"), (2, "", 9, "x"), (3, long_text, 9, "x"), (4, long_text, 9, "x"), (5, "one", 9, "x"),
         (5, "one", 9, "x"), (None, "two words", 9, "x"), (None, None, 9, "x")],
        "doc_id long, text string, component_id int, FP string",
    )
    got = rows(simhash.near_duplicates(docs).select("doc_id", "component_id"))
    assert got == rows(spark.createDataFrame(
        [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (5, 5), (None, None), (None, 1)], "a long, b long"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert rows(kept.select("doc_id")) == [(None,), (1,), (3,), (5,)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_or_have_none_stay_by_their_texts(spark):
    a, b, c, d = ("one two three four", "five six seven eight", "nine ten eleven twelve", "red green blue grey")
    docs = spark.createDataFrame(
        [(3, a), (7, a), (7, b), (7, c), (7, c), (None, d), (None, "pink white"), (None, "pink white"), (None, b)],
        "doc_id long, text string")
    assert rows(simhash.keep_one(docs)) == [(None, "pink white"), (None, d), (3, a), (7, b), (7, c)]


def test_groups_stay_small_where_many_points_share_a_half(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 500)
    placed = spark.range(9_000).selectExpr("if(id < 6000, 0, 1 + id % 3) shard", "id fp", "id % 5 > 0 home")
    groups = simhash.dealt(placed.selectExpr("cast(shard as int) shard", "fp", "home")).groupBy("shard", "i", "j").agg(
        F.count("*").alias("n"), F.count_if("home").alias("stored"), F.count_if("asks").alias("asked")).collect()
    assert max(r.stored for r in groups) < 700 and max(r.asked for r in groups) < 700
    hot = [r for r in groups if r["shard"] == 0]
    # Each stored block of the hot shard meets each asked one: all pairs of the shard, once.
    assert len(hot) == 10 * 12 and sum(r.stored for r in hot) == 4800 * 12 and sum(r.asked for r in hot) == 6000 * 10

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from sentinela.llm import periodicity
from sentinela.llm.queries import QUERIES

SMALLEST = "/root/testdata/sf0.001"


def plain_runs(words):
    """By definition: every maximal stretch of every period whose smallest period that is."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i:i + length]
            smaller = any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbers(words):
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.array([names[w] for w in words], np.int64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 7)), max_size=8))
def test_runs_are_those_of_the_definition(blocks):
    words = [w for block, times in blocks for w in block * times]
    assert sorted(periodicity.runs_of(numbers(words)), key=lambda r: (r[0], r[2])) == plain_runs(words)


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=150))
def test_runs_of_two_words(letters):
    assert sorted(periodicity.runs_of(numbers(letters)), key=lambda r: (r[0], r[2])) == plain_runs(list(letters))


def test_long_texts_of_few_words_are_not_quadratic():
    assert periodicity.runs_of(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    block = np.arange(50_000)
    assert periodicity.runs_of(np.tile(block, 10)) == [(0, 500_000, 50_000)]
    assert periodicity.runs_of(np.tile(block, 3)) == []


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALLEST}/documents.parquet").collect()}
    # The plain version takes the square of a text's words.
    short = {i for i, t in docs.items() if len(t or "") < 6000}
    found = QUERIES["op11_periodic_runs"](spark, SMALLEST)
    assert found.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {r.doc_id: tuple(r)[:8] for r in found.collect()}
    assert set(rows) == set(docs) and len(short) > 150
    assert sum(r[1] > 0 for r in rows.values()) > 10
    for i in short:
        assert rows[i] == plain_row(i, docs[i])


def test_odd_rows(spark):
    data = [(None, None, "x", "y"), (1, "", "x", "y"), (2, "a\tb\x0ba b a b\na b", "x", "y"), (2, "a\tb\x0ba b a b\na b", "x", "y"),
            (3, "é é " * 6, "x", "y"), (None, "a a a a a a", "x", "y")]
    df = spark.createDataFrame(data, "doc_id long, text string, RUNS string, collapsed string")
    found = periodicity.detect(df)
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect())
    assert got == [(0, [], ""), (0, [(0, 6, 1)], "a"), (1, [], ""), (2, [(0, 8, 2)], "a b"), (2, [(0, 8, 2)], "a b"),
                   (3, [(0, 6, 1)], "é é")]
    assert periodicity.detect(df.limit(0)).count() == 0
    same = periodicity.repeat_tails(df).where("doc_id is null").collect()
    assert sorted(r.text for r in same) == ["", "a a a a a a"]


def test_hostile_lengths_in_one_batch(spark):
    texts = ["x " * 200_000, " ".join(map(str, range(100_000))), "ab cd " * 50_000 + "ef"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: ([tuple(x) for x in r.runs], len(r.collapsed.split())) for r in periodicity.detect(df).collect()}
    assert got == {0: ([(0, 200_000, 1)], 1), 1: ([], 100_000), 2: ([(0, 100_000, 2)], 3)}

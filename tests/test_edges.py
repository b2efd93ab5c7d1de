"""Edge lines and headers of files, whatever the splits, line ends and sizes."""

import gzip
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sentinela.config import LiteralColumn
from sentinela.sources.delimited import file_headers, read_aligned, read_without_edges
from sentinela.sources.lines import add_date_from_line, drop_edge_lines, header_line, positioned_lines, with_header_line
from sentinela.sources.ranges import CHUNK, Head, file_heads, last_start
from sentinela.staging import scratch_root
from tests.test_sources import put

SPLIT = "spark.sql.files.maxPartitionBytes"


def plain_lines(data):
    """Lines with the places where they begin."""
    out, at = [], 0
    for m in re.finditer(rb"([^\r\n]*)(\r\n|\n|\r|$)", data):
        if m.end() == at:
            break
        out.append((at, m.group(1)))
        at = m.end()
    return out


def random_file(r):
    data = b""
    for _ in range(r.choice([0, 1, 2, 5, 60])):
        data += b"x" * r.choice([0, 1, 7, 40, 300]) + str(r.randrange(9)).encode() * r.choice([0, 1]) + r.choice([b"\n", b"\r\n", b"\r"])
    return data + r.choice([b"", b"no break"])


@pytest.fixture()
def split_bytes(spark):
    before = spark.conf.get(SPLIT)
    yield lambda n: spark.conf.set(SPLIT, n)
    spark.conf.set(SPLIT, before)


@pytest.mark.parametrize("size", ["16b", "97b", "256b", "1m"])
def test_edges_of_any_split_and_line_end(spark, folder, split_bytes, size):
    r = random.Random(size)
    files = {f"{i}.txt": random_file(r) for i in range(24)}
    for name, data in files.items():
        put(folder, name, data)
    split_bytes(size)
    lines = positioned_lines(spark, folder).withColumn("name", F.element_at(F.split("_file", "/"), -1))
    for header, footer in [(0, True), (1, False), (3, True)]:
        want = sorted((n, x.decode()) for n, d in files.items() for x in [t for _, t in plain_lines(d)][header:None])
        if footer:
            want = sorted((n, x.decode()) for n, d in files.items() for i, (_, x) in enumerate(plain_lines(d))
                          if header <= i < len(plain_lines(d)) - 1)
        got = sorted(tuple(x) for x in drop_edge_lines(lines, header, footer).select("name", "value").collect())
        assert got == want


def test_last_lines_and_heads_by_ranges(folder):
    r = random.Random(1)
    for i in range(60):
        data = random_file(r) if i % 3 else b"a\n" + b"y" * r.choice([CHUNK - 1, CHUNK, 3 * CHUNK]) + r.choice([b"", b"\n", b"\r\n"])
        path, lines = put(folder, f"{i}.txt", data), plain_lines(data)
        if lines:
            assert last_start(f"file://{path}", len(data)) == lines[-1][0]
        head = Head(f"file://{path}", 2)
        assert [(a, x) for a, x in zip(head.starts, head.lines)] == lines[:2]


def test_bytes_read_for_headers_do_not_grow_with_the_file(spark, folder):
    for n in (1_000, 200_000):
        put(folder, f"{n}.csv", "a,b\n" + "1,2\n" * n)
    found = file_heads(spark, spark.read.text(folder).inputFiles()).collect()
    assert [x["_line"] for x in found] == ["a,b"] * 2 and max(x["_read"] for x in found) <= CHUNK
    assert [x["_line"] for x in file_headers(spark, folder).collect()] == ["a,b"] * 2
    assert read_aligned(spark, folder, ["b"]).count() == 201_000


def test_many_files_are_spread_over_tasks(spark, folder):
    for i in range(150):
        put(folder, f"{i}.csv", f"h{i}\n1\n")
    heads = file_heads(spark, spark.read.text(folder).inputFiles())
    assert heads.rdd.getNumPartitions() == 3 and {x["_line"] for x in heads.collect()} == {f"h{i}" for i in range(150)}
    assert file_heads(spark, []).count() == 0


def staged(spark):
    return {os.path.join(at, f) for at, _, files in os.walk(scratch_root(spark)) for f in files}


def test_no_line_is_written_on_the_way(spark, folder, split_bytes):
    put(folder, "1.txt", "H 20260417\n" + "row\n" * 500 + "TAIL\n")
    split_bytes("300b")
    before = staged(spark)
    lines = positioned_lines(spark, folder)
    dated = add_date_from_line(drop_edge_lines(lines, 1, True), lines, LiteralColumn("d", "yyyyMMdd", line=0, start=2, end=10))
    assert dated.count() == 500 and dated.select("d").distinct().count() == 1
    assert staged(spark) == before
    plan = dated._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_later_filters_stay_behind_the_edges(spark, folder, split_bytes):
    put(folder, "1.txt", "HEAD\nskip\n" + "keep\n" * 200 + "skip\n")
    split_bytes("300b")
    kept = drop_edge_lines(positioned_lines(spark, folder), 2, True).filter("value <> 'HEAD'").filter("value <> 'skip'")
    assert kept.count() == 200


def test_compressed_files(spark, folder):
    put(folder, "1.txt.gz", gzip.compress(b"H 20260417\na\nb\nTAIL\n"))
    lines = positioned_lines(spark, folder)
    kept = drop_edge_lines(lines, 1, True)
    assert sorted(r.value for r in kept.collect()) == ["a", "b"]
    assert [r["_line"] for r in header_line(lines).collect()] == ["H 20260417"]
    assert {r["_line"] for r in with_header_line(kept).collect()} == {"H 20260417"}


def test_headers_in_another_encoding(spark, folder):
    put(folder, "1.csv", "código;nome\nkg;x\n1;São\n", "latin-1")
    lines = positioned_lines(spark, folder, "ISO-8859-1")
    got = read_without_edges(lines, ["CÓDIGO", "nome"], True, ";", skip_first=True, encoding="ISO-8859-1")
    assert [tuple(r)[:2] for r in got.collect()] == [("1", "São")]


def test_empty_files_and_missing_lines(spark, folder):
    put(folder, "1.txt", "")
    put(folder, "2.txt", "only")
    lines = positioned_lines(spark, folder)
    assert drop_edge_lines(lines, 1, True).count() == 0 and header_line(lines, 3).count() == 0
    assert [r["_line"] for r in with_header_line(lines, 3).collect()] == [None]

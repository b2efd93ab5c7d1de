import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sentinela.llm import sequences
from sentinela.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_query_as_the_library(spark):
    library, start, want = Tokenizer.from_file(PATH), 0, []
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = QUERIES["op6_token_sequences_arrow"](spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == want


def test_file_round_trip_and_random_access(folder):
    chance = np.random.default_rng(2)
    for size, kind in ((1000, pa.uint16()), (100_000, pa.uint32())):
        path = f"{folder}/{size}.arrows"
        run = [chance.integers(0, size, n, np.uint32) for n in (0, 5, 100, 1, 333, 64)]
        with pa.OSFile(path, "wb") as sink:
            writer = sequences.SequenceWriter(sink, size, length=8, rows=4)
            for ids in run:
                writer.add(ids)
            writer.close()
        whole = np.concatenate(run)
        file = sequences.SequenceFile(pa.memory_map(path))
        assert file.batches[0].schema.field("ids").type == pa.list_(kind, 8)
        assert {b.num_rows for b in file.batches[:-1]} == {4}
        for start, n in ((0, 0), (0, 503), (31, 2), (32, 32), (40, 100), (502, 1)):
            assert (file.tokens(start, n) == whole[start:start + n]).all()
        ids, mask = file.sequence(62)
        assert ids.to_pylist() == whole[496:].tolist() + [0] and mask.to_pylist() == [True] * 7 + [False]
        mapped = file.tokens(0, 8)
        assert not mapped.flags.owndata


def test_odd_rows(spark, folder):
    docs = spark.createDataFrame(
        [(2, None, "x"), (1, "", "x"), (5, "word " * 50_000, "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "c", "x")],
        "doc_id long, text string, START string")
    manifest = sequences.write(docs, f"{folder}/a", PATH, end_id=1)
    assert sorted(map(tuple, sequences.read(spark, manifest).select("start", "doc_id", "n_tokens").collect())) == [
        (0, None, 2), (2, 1, 1), (3, 2, 1), (4, 3, 3), (7, 3, 3), (10, 5, 50_001)]
    empty = sequences.write(docs.limit(0), f"{folder}/b", PATH, end_id=1)
    assert empty.starts == () and sequences.read(spark, empty).count() == 0


def test_rows_of_one_id_go_over_many_tasks(spark, folder):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 7, if(id % 3 = 1, null, id)) doc_id", "if(id % 2 = 0, 'same text', concat('text ', id)) text")
    try:
        manifest = sequences.write(docs, f"{folder}/a", PATH, end_id=1)
    finally:
        spark.conf.unset(key)
    found = sequences.read(spark, manifest)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 3000 / 8
    rows = sorted(found.collect(), key=lambda r: r.start)
    assert [r.start + r.n_tokens for r in rows[:-1]] == [r.start for r in rows[1:]] and rows[0].start == 0
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids) and len(ids) == 3000

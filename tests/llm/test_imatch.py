import collections
import hashlib
import re
import struct

import regex
import xxhash

from pyspark.sql import functions as F

from sentinela.llm import imatch
from sentinela.llm.queries import QUERIES
from tests.conftest import rows

SMALL = "/root/testdata/sf0.001"


def test_query_as_computed_plainly(spark):
    found = {r.doc_id: r for r in QUERIES["op2_imatch_fingerprints"](spark, SMALL).collect()}
    docs = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect(), reverse=True)
    assert len(found) == len(docs)
    by_text = {}
    for i, r in enumerate(docs):
        text, following = r.text or "", docs[(i + 1) % len(docs)]
        half = len(text) // 2
        edited = text[:len(text) - half] + (following.text or "")[:half]
        got = found[r.doc_id]
        assert got.n_chars == len(text)
        assert got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, got.fingerprint) == got.fingerprint
        split = [re.findall("....", x) for x in (got.fingerprint, got.edited_fingerprint, found[following.doc_id].fingerprint)]
        for near, other in ((got.near_edited, split[1]), (got.near_next, split[2])):
            held = [a == b for a, b in zip(split[0], other) if (a, b) != ("0000", "0000")]
            want = sum(held) / len(held) if held else float(split[0] == other)
            assert abs(near - want) < 1e-12
    near = [(r.near_edited, r.near_next) for r in found.values()]
    assert sum(a > b for a, b in near) > 0.85 * len(near)


def test_lexicon_is_the_band(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RAREST", 0.3)
    monkeypatch.setattr(imatch, "COMMONEST", 0.6)
    texts = ["a b c", "A b", "a, d!", "a d e", "a a a", None, "a b", "a d", "a", "a f"]
    docs = spark.createDataFrame([(t or "",) for t in texts], "text string")
    got = imatch.lexicon(docs).first().terms
    want = [r[0] for r in spark.sql("SELECT xxhash64(t) FROM VALUES ('b'), ('d') AS v(t)").collect()]
    assert sorted(got) == sorted(want)


def test_same_terms_same_fingerprint(spark):
    docs = spark.createDataFrame([(i, f"x{i % 7} y{i % 5} z{i % 3} q") for i in range(60)], "doc_id long, text string")
    known = imatch.lexicon(docs.select("text"))
    pairs = spark.createDataFrame([("x1 y2 z0", "Y2, z0; X1 x1!"), ("x1 y2", "x1 y3")], "a string, b string")
    both = imatch.fingerprinted(imatch.fingerprinted(pairs, "a", known, "fa"), "b", known, "fb")
    assert [r[0] for r in both.select(imatch.likeness(F.col("fa"), F.col("fb"))).collect()][0] == 1.0
    assert both.where("fa = fb").count() == 1


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(9, "tail of the last", "x"), (4, None, "x"), (4, "", "x"), (7, "same", "x"), (7, "same", "x"), (7, "other", "x"),
         (None, "no id", "x"), (1, "long text " * 40_000, "x")], "doc_id long, text string, FINGERPRINT string")
    found = imatch.with_edited(docs).select("doc_id", "n_chars", "edited", "near_edited", "near_next").collect()
    assert len(found) == 8
    edited = {(r.doc_id, r.n_chars): r.edited for r in found}
    assert edited[(1, 400_000)] == ("long text " * 20_000) + "no id"
    assert edited[(None, 5)] == "no " + "ta"
    assert edited[(4, 0)] == ""
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    alone = imatch.with_edited(docs.limit(1)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert imatch.with_edited(docs.limit(0)).count() == 0


def test_neighbours_over_many_partitions(spark):
    keys = spark.range(5000).select((F.col("id") * 3 % 15001).alias("k"), F.lit(1).cast("long").alias("h"))
    ids = sorted((r.k for r in keys.collect()), reverse=True)
    want = dict(zip(ids, ids[1:] + ids[:1]))
    assert {r.k: r.next_k for r in imatch.successors(keys).collect()} == want


def xx(value, seed):
    """XXH64 as the engine chains it over columns: text, 64-bit or 32-bit whole numbers."""
    data = value.encode() if isinstance(value, str) else value
    return xxhash.xxh64_intdigest(data, seed)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_fingerprint(text, known):
    every = {signed(xx(t, 42)) for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t}
    kept = sorted(every & known or every or {signed(xx(text, 42))})
    out = ""
    for size, n in imatch.PARTS.items():
        for k in range(n):
            h = 42
            for t in kept:
                chosen = xx(struct.pack("<i", size), xx(struct.pack("<i", k), xx(struct.pack("<q", t), 42)))
                if signed(chosen) % size == 0:
                    h = xx(struct.pack("<q", t), h)
            out += f"{h >> 48:04x}"
    return out


def test_fingerprints_by_another_implementation(spark):
    """Lexicon, parts and hashes of the whole smallest table, in plain Python."""
    found = {r.doc_id: r for r in QUERIES["op2_imatch_fingerprints"](spark, SMALL).collect()}
    docs = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect(), reverse=True)
    texts = [r.text or "" for r in docs]
    seen = collections.Counter()
    for t in texts:
        seen.update({signed(xx(w, 42)) for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w})
    total = len(texts)
    known = {t for t, n in seen.items() if max(2, total * imatch.RAREST) <= n <= total * imatch.COMMONEST}
    for i, r in enumerate(docs):
        text, onward = texts[i], texts[(i + 1) % total]
        half = len(text) // 2
        assert found[r.doc_id].fingerprint == plain_fingerprint(text, known)
        assert found[r.doc_id].edited_fingerprint == plain_fingerprint(text[:len(text) - half] + onward[:half], known)

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sentinela.llm import contamination
from tests.llm.test_simhash import plain_components, plain_fingerprint

DATA = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def results(spark):
    """Every stage's input and output."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = [docs.cache()]
    for _, step in corpus_pipeline.STAGES:
        found.append(step(spark, found[-1], DATA).cache())
    return found


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_are_as_asked():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "bpe"]


def test_filters_keep_columns_and_rows_as_they_are(results):
    for before, after in zip(results[:3], results[1:4]):
        assert after.columns == before.columns
        old, new = by_id(before), by_id(after)
        assert 0 < len(new) < len(old) and all(old[i] == r for i, r in new.items())
    assert results[4].columns == results[3].columns and results[4].count() == results[3].count()


def test_toxic_texts_go(spark, results):
    kept = by_id(results[1])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    clean = [i for i, y in labels.items() if y == 0]
    toxic = [i for i, y in labels.items() if y == 1]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)
    assert sum(i not in kept for i in toxic) >= 0.6 * len(toxic)


def test_one_of_each_group_stays(results):
    prints = {i: plain_fingerprint(r.text) for i, r in by_id(results[1]).items()}
    assert set(by_id(results[2])) == set(plain_components(prints).values())


def test_leaks_go(spark, results):
    items = [contamination.plain(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = by_id(results[3])
    for i, r in by_id(results[2]).items():
        if any(t in contamination.plain(r.text or "") for t in items):
            assert i not in kept
    found = {r.doc_id for r in contamination.matches(results[2], spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert set(kept) == set(by_id(results[2])) - found


def test_surrogates_and_tokens(results):
    library, texts, last = Tokenizer.from_file(PATH), by_id(results[4]), by_id(results[5])
    changed = sum(r.text != texts[i].text for i, r in by_id(results[3]).items())
    assert changed > 5 and all(r.n_chars == len(r.text) for r in texts.values() if r.text is not None)
    assert set(last) == set(texts)
    for i, r in last.items():
        ids = library.encode(texts[i].text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        names = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(names.encode()).hexdigest()


def test_run_is_all_stages(spark, results):
    run = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, results[5].collect()))


def test_odd_rows_through_every_stage(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "a b c d", "en", "s", 7, "x"),
                                  (3, "a b c d", "en", "s", 7, "x"), (None, "mail a@b.org now", "en", "s", 5, "x")],
                                 "doc_id long, text string, lang string, source string, n_chars long, score string")
    for rows in (docs, docs.limit(0)):
        now = rows
        for _, step in corpus_pipeline.STAGES:
            now = step(spark, now, "/root/testdata/sf0.001")
            if "text" in now.columns:
                assert now.columns == docs.columns
        now.collect()

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sentinela.llm import bpe
from sentinela.llm.queries import QUERIES
from tests.conftest import rows

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_random_texts_as_the_library(library):
    chance = random.Random(1)
    letters = " \t\n\x1c\x85\xa0\u3000ab'stlLd9!_-<|>\u0301\u00e9\u03a3\u0130\u00df\u4f60\U0001f600"
    texts = ["".join(chance.choice(letters) for _ in range(chance.randint(0, 40))) for _ in range(800)]
    texts += [t + s + t for t, s in zip(texts, ["<|endoftext|>", "x<|endoftext|>'s <|startoftext|>", "aaaaaaa"] * 60)]
    coder = bpe.Encoder(PATH)
    for text, (ids, names) in zip(texts, coder.encode(texts)):
        want = expected(library, text)
        assert (np.frombuffer(ids, "<u4").tolist(), str(names, "utf-8")) == want
        assert coder.decode(ids) == want[1]


def test_a_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 4)
    coder = bpe.Encoder(PATH)
    texts = ["one two three four", "five six one", "", "seven"]
    assert [np.frombuffer(i, "<u4").tolist() for i, _ in coder.encode(texts)] == [expected(library, t)[0] for t in texts]


def test_query(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in docs:
        ids, names = expected(library, r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(names.encode()).hexdigest()))
    got = QUERIES["op3_bpe_pair_index"](spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_odd_rows_and_round_trip(spark, library):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "word " * 100_000, "x"), (3, "word " * 100_000, "x"), (None, "a b", "x")],
        "doc_id long, text string, N_TOKENS string")
    coded = bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert rows(coded.select("doc_id", "n_tokens")) == [(None, 2), (1, 0), (2, 0), (3, 100_000), (3, 100_000)]
    again = bpe.decode(coded, PATH, to="again")
    assert again.where("again != decoded").count() == 0
    assert bpe.encode(docs.limit(0), PATH).count() == 0

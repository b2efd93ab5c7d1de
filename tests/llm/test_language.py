import zlib

import numpy as np

from sentinela.llm import language
from sentinela.llm.queries import QUERIES
from pyspark.sql import functions as F
from tests.conftest import rows

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = QUERIES["op1_language_bloom_slices"](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(docs, "doc_id")
    assert found.count() == docs.count()
    right, n = held.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right / n > 0.98
    assert held.where("score < 0 or score > 1").count() == 0


def test_looking_up_all_languages_at_once_is_looking_up_each(spark):
    texts = [("der hund und die katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr")] * 4
    filters = language.fit(spark.createDataFrame(texts, "text string, lang string"))
    assert filters.languages == ["de", "en", "fr"]
    h, good, _, _ = language.grams([t for t, _ in texts], 3)
    together = filters.bits(h[good])[:, 0]
    for i in range(3):
        alone = np.ones(good.sum(), bool)
        for p in range(language.PROBES):
            at = (h[good] >> np.uint64(20 * p)) & np.uint64(language.POSITIONS - 1)
            alone &= (filters.words[at, 0] >> np.uint8(i) & 1).astype(bool)
        assert (alone == (together >> np.uint8(i) & 1).astype(bool)).all()


def test_more_languages_than_bits_of_a_word(spark):
    texts = [(f"{chr(97 + i % 26)}{chr(97 + i // 26)}x" * 6 + " ", f"l{i:03d}") for i in range(130)]
    df = spark.createDataFrame([t for t in texts for _ in range(3)], "text string, lang string")
    found = language.identify(df, language.fit(df))
    assert found.where("lang != lang_pred").count() == 0


def test_odd_rows(spark):
    learnt = spark.createDataFrame([("der hund und die katze", "de"), ("the dog and the cat", "en")] * 3, "text string, lang string")
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "12 34 !?", "x"), (4, "the cat " * 50_000, "x"), (None, "die katze", "x"),
         (None, "die katze", "x"), (5, "\u4f60\u597d", "x")], "doc_id long, text string, SCORE string")
    found = language.identify(docs, language.fit(learnt))
    assert found.columns == ["doc_id", "text", "lang_pred", "score"]
    assert rows(found.select("doc_id", "lang_pred")) == [
        (None, "de"), (None, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de")]
    assert found.where("lang_pred = 'und' and score != 0").count() == 0
    assert language.fit(learnt.limit(0)) is None
    assert rows(language.identify(docs.limit(1), None).select("lang_pred", "score")) == [("und", 0.0)]
    assert language.identify(docs.limit(0), None).count() == 0


def test_copies_of_a_text_count_once_in_the_fit(spark):
    texts = [("the quick brown fox jumps over the lazy dog", "en"), ("the dog and the fox are quick and brown", "en"),
             ("der schnelle braune fuchs springt weit", "de"), ("der fuchs und der hund sind braun und schnell", "de")]
    # Blanks within the texts, so that it does not matter which ones share a batch.
    texts = [(f". {t} .", lang) for t, lang in texts]
    copies = texts + [(". zzzz yyyy xxxx wwww zzzz yyyy xxxx wwww .", "en")] * 1500
    one, many = (language.fit(spark.createDataFrame(t, "text string, lang string")) for t in (copies[:5], copies))
    assert (one.words == many.words).all()


def plain_score(text, filters):
    """Language and score of one text, gram by gram."""
    word, letters = (1 << 64) - 1, "".join(c if c.isalpha() else " " for c in text.lower())
    if not any(c.isalpha() for c in text.lower()):
        return "und", 0.0
    counts, total = [0] * len(filters.languages), 0
    # One blank more at the end, since texts are followed by blanks.
    padded = letters + " "
    for size in language.SIZES:
        for i in range(len(padded) - size + 1):
            gram = padded[i:i + size]
            if "  " in gram:
                continue
            total += 1
            h = ord(gram[0])
            for c in gram[1:]:
                h = (h * int(language.ROLL) + ord(c)) & word
            h = int(language.mixed(np.array([h], np.uint64))[0])
            bits = word
            for p in range(language.PROBES):
                bits &= int(filters.words[h >> 20 * p & language.POSITIONS - 1, 0])
            for k in range(len(counts)):
                counts[k] += bits >> k & 1
    real = [max(0.0, n - total * share) / (1 - share) for n, share in zip(counts, filters.false_share)]
    best = max(range(len(real)), key=lambda k: (real[k], -k))
    return filters.languages[best], real[best] / sum(real) if sum(real) else 0.0


def test_query_by_another_implementation(spark):
    """Every text of the smallest table, gram by gram, with the filters that the query learns."""
    smallest = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{smallest}/documents.parquet").select("doc_id", "text", "lang")
    learnt = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0]
    filters = language.fit(spark.createDataFrame(learnt, docs.schema))
    got = {r.doc_id: r for r in QUERIES["op1_language_bloom_slices"](spark, smallest).collect()}
    for r in docs.collect():
        lang, score = plain_score(r.text or "", filters)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-9
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_a_text_is_judged_apart_from_its_neighbours(spark):
    texts = ["der hund und die katze", "the dog and the cat", "le chien et le chat"]
    filters = language.fit(spark.createDataFrame([(t, k) for t, k in zip(texts, ("de", "en", "fr"))] * 4, "text string, lang string"))
    alone = [filters.scores([t])[1][0] for t in texts]
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        together = filters.scores([texts[i] for i in order])[1]
        assert np.allclose(together, [alone[i] for i in order], atol=1e-12)

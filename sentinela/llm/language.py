"""Language identification with bit-sliced Bloom filters of character n-grams.

All languages share one array of positions; a position holds one bit for each language. Looking up
an n-gram takes the conjunction of a few positions, which at once names every language whose filter
holds the n-gram. For each text the bits are counted by language, the counts are corrected for the
filters' known shares of false positives, and the largest corrected share decides.

An n-gram enters the filter of each language in which its share is at least ``MARGIN`` of its
largest share in any language. The filters are fitted on a bounded sample of labelled rows
(``DOCS_PER_LANGUAGE`` in expectation, chosen by a hash); only n-grams above a fixed share of a
language's n-grams are used, so at most ``1 / LEAST_SHARE`` reach the driver for each language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if
there is nothing to learn from. A text none of whose n-grams is known gets the first language, with
score 0. Rows of equal text get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sentinela.llm.arrays import ROLL, code_points, letter_table, mixed
from sentinela.llm.tables import slices, text_or_empty

SIZES = (3, 4)
DOCS_PER_LANGUAGE, LEAST_SHARE, MARGIN = 2_000, 1 / 20_000, 0.5
POSITIONS, PROBES = 1 << 18, 3
UNKNOWN = "und"


def grams(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the n-gram at each place, whether it counts, where texts start, and letters per text.

    What is no letter counts as one blank; an n-gram with two blanks in a row, as between texts, does not count.
    """
    codes, starts = code_points([t.lower() for t in texts], gap=2)
    is_letter = letter_table()[codes]
    letters = np.add.reduceat(is_letter, starts, dtype=np.int64)
    x = np.where(is_letter, codes, 32).astype(np.uint64)
    n = len(x) - size + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, bool), starts, letters
    h = x[:n].copy()
    for i in range(1, size):
        h *= ROLL
        h += x[i:i + n]
    two = is_letter[:-1] | is_letter[1:]
    good = two[:n].copy()
    for i in range(1, size - 1):
        good &= two[i:i + n]
    # The blank before a text begins no n-gram, which would be counted for the text before it.
    before = starts[1:] - 1
    good[before[before < n]] = False
    return mixed(h), good, starts, letters


@dataclass
class Filters:
    languages: list[str]
    words: np.ndarray  # positions x words of 64 languages
    false_share: np.ndarray

    def bits(self, h: np.ndarray) -> np.ndarray:
        found = None
        for i in range(PROBES):
            at = (h >> np.uint64(20 * i)) & np.uint64(POSITIONS - 1)
            found = self.words[at] if found is None else found & self.words[at]
        return found

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number, its share of all corrected counts, and the letters of each text."""
        counts, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for size in SIZES:
            h, good, starts, letters = grams(texts, size)
            # Texts are followed by two blanks, so only the very last starts may lie beyond the last n-gram.
            starts = np.minimum(starts, max(len(h) - 1, 0))
            if not len(h):
                continue
            total += np.add.reduceat(good, starts, dtype=np.int64)
            found = np.where(good[:, None], self.bits(h), 0)
            for i in range(len(self.languages)):
                hit = (found[:, i // 64] >> found.dtype.type(i % 64)) & found.dtype.type(1)
                counts[:, i] += np.add.reduceat(hit, starts, dtype=np.int64)
        real = np.maximum(counts - total[:, None] * self.false_share, 0) / (1 - self.false_share)
        best, whole = real.argmax(axis=1), real.sum(axis=1)
        return best, np.where(whole > 0, real.max(axis=1) / np.maximum(whole, 1e-300), 0.0), letters


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Filters | None:
    """Filters learned from the rows with text and language; None if there are none."""
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    per_language = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not per_language:
        return None
    languages = sorted(per_language)
    spark = df.sparkSession
    shares = spark.createDataFrame(
        [(k, min(1.0, DOCS_PER_LANGUAGE / n)) for k, n in per_language.items()], "__lang string, __share double")
    dice = F.pmod(F.xxhash64(text), F.lit(1_000_003)) / 1_000_003
    sample = rows.join(F.broadcast(shares), rows[lang] == shares["__lang"]).where(dice < F.col("__share"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, group in batch.groupby("lang"):
                texts = group["text"].tolist()
                for start, end in slices(texts):
                    for size in SIZES:
                        h, good, _, _ = grams(texts[start:end], size)
                        values, n = np.unique(h[good], return_counts=True)
                        yield pd.DataFrame({"lang": language, "size": size, "gram": values.view(np.int64), "n": n})

    counted = (
        # Copies of a text count once: the dice take or leave them together.
        sample.select(F.col(text).alias("text"), F.col(lang).alias("lang")).distinct()
        .mapInPandas(count, "lang string, size int, gram long, n long")
        .groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    )
    shared = counted.groupBy("lang", "size").agg(F.sum("n").alias("all"))
    kept = counted.join(F.broadcast(shared), ["lang", "size"]).where(F.col("n") >= F.greatest(F.lit(2), F.col("all") * LEAST_SHARE))
    found = kept.select("lang", "gram", (F.col("n") / F.col("all")).alias("share")).toPandas()
    most = found.groupby("gram")["share"].transform("max")
    found = found[found["share"] >= MARGIN * most]
    width = -(-len(languages) // 64)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    words = np.zeros((POSITIONS, width), kind)
    for i, language in enumerate(languages):
        h = found.loc[found["lang"] == language, "gram"].to_numpy(np.int64).view(np.uint64)
        for p in range(PROBES):
            words[(h >> np.uint64(20 * p)) & np.uint64(POSITIONS - 1), i // 64] |= kind(1 << (i % 64))
    filled = [((words[:, i // 64] >> kind(i % 64)) & kind(1)).mean() for i in range(len(languages))]
    return Filters(languages, words, np.array(filled) ** PROBES)


def languages(text: Column, filters: Filters | None) -> Column:
    """Struct ``lang_pred string, score double`` for a text column without nulls."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array([*(filters.languages if filters else []), UNKNOWN], dtype=object)
        for batch in batches:
            texts, pred, score = batch.tolist(), [], []
            for start, end in slices(texts):
                if filters is None:
                    pred += [UNKNOWN] * (end - start)
                    score += [0.0] * (end - start)
                    continue
                best, share, letters = filters.scores(texts[start:end])
                pred += names[np.where(letters > 0, best, -1)].tolist()
                score += np.where(letters > 0, share, 0.0).tolist()
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    return F.pandas_udf(run, "lang_pred string, score double")(text)


def identify(df: DataFrame, filters: Filters | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``; input columns of these names are replaced. No shuffle."""
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("lang_pred", "score")]
    found = df.select(*kept, languages(text_or_empty(text), filters).alias("__found"))
    return found.select(*kept, "__found.lang_pred", "__found.score")

"""Runs of periodic words: stretches that repeat one block of words at least four times.

An online sparse program over diagonals. The diagonal of lag d holds the words that equal the word d
places before; a word's earlier occurrences increment the match lengths of their lags, and a
diagonal that a word does not continue has ended and is emitted at once if it is long enough.

Which earlier occurrences count keeps the program sparse. A period q with L/2 < q <= L, L a power of
two, fills a run of at least four periods, in which every window of L words recurs q words later and
not sooner: if it recurred sooner, at d, then d + q <= 2L words had both periods and hence their
greatest common divisor, so q were not the smallest period. So a lag d is incremented only from a word's *nearest* earlier
occurrence in the same context, which is the word with the L - 1 before it, L the smallest power of two
not under d; the diagonal then starts with L matched words. That finds every run once, with its
smallest period and both true ends, from at most one earlier occurrence a word and context. Contexts
of 2L words are made of two of L, and only of such as occur twice, so long ones hardly exist in common texts
while a text of one word costs n log n.

Defined cases: a null text has no words; words are ``[^\\x20\\x09-\\x0D]+``, compared byte for byte; a
text without runs gives an empty array and its words joined by single blanks. Rows are independent
of each other: equal rows give equal results, an empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sentinela.llm.tables import slices, text_or_empty, without

LEAST_WORDS, LEAST_PERIODS = 6, 4
RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])
RESULT = StructType([StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])


def _contexts(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each context length: places whose nearest earlier occurrence has a lag of that length, and the lags."""
    at, key, reach, n = np.arange(len(words)), words.astype(np.int64), 1, len(words)
    named = np.empty(n, np.int64)
    while len(at):
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        before, here = at[order[:-1][same]], at[order[1:][same]]
        near = (here - before > reach // 2) & (here - before <= reach)
        yield reach, here[near], (here - before)[near]
        # Names of the contexts that occur twice; others cannot be part of a longer one that does.
        name = np.empty(len(at), np.int64)
        name[order] = np.r_[0, np.cumsum(~same)]
        twice = np.zeros(len(at), bool)
        twice[order[:-1][same]] = twice[order[1:][same]] = True
        named[:] = -1
        named[at[twice]] = name[twice]
        at = at[twice & (at >= reach)]
        at = at[named[at - reach] >= 0]
        key, reach = named[at] * n + named[at - reach], reach * 2


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, length and period of all runs, by end; ``words`` are numbers, equal where words are."""
    found = list(_contexts(words))
    if not found:
        return []
    place, lag = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
    context = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
    order = np.lexsort((lag, place))
    out: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}
    now: dict[int, int] = {}
    last = -1

    def end(lags, at: int) -> None:
        for d in lags:
            length = active[d] + d
            if length >= max(LEAST_WORDS, LEAST_PERIODS * d):
                out.append((at - length + 1, length, d))

    for i, d, reach in zip(place[order].tolist(), lag[order].tolist(), context[order].tolist()):
        if i != last:
            # The word at ``last`` is done: what it did not continue has ended before it.
            end([k for k in active if k not in now], last - 1)
            active, now = now, {}
            if i != last + 1:
                end(active, last)
                active = {}
            last = i
        now[d] = active.get(d, reach - 1) + 1
    end([k for k in active if k not in now], last - 1)
    active = now
    end(active, last)
    return out


def words_of(text: str) -> list[bytes]:
    """Words between blanks and the control characters from tab to carriage return."""
    return text.encode("utf-8", "surrogatepass").split()


def _analysed(texts: list[str]) -> tuple[list[list[dict]], list[str]]:
    split = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for words in split for w in words]
    codes, kinds = pd.factorize(flat)
    # Words of different texts differ, so that nothing matches across texts.
    owner = np.repeat(np.arange(len(split)), sizes)
    kept = np.ones(len(flat), bool)
    runs: list[list[dict]] = [[] for _ in split]
    for start, length, period in runs_of(owner * max(1, len(kinds)) + codes):
        kept[start + period:start + length] = False
        text = int(owner[start])
        runs[text].append({"start": start - int(ends[text] - sizes[text]), "length": length, "period": period})
    collapsed = []
    for text, (a, b) in enumerate(zip(ends - sizes, ends)):
        runs[text].sort(key=lambda r: (r["start"], r["period"]))
        words = split[text] if not runs[text] else flat[a:b][kept[a:b]].tolist()
        collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    return runs, collapsed


@F.pandas_udf(RESULT)
def _detected(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, runs, collapsed = batch.tolist(), [], []
        for a, b in slices(texts):
            found = _analysed(texts[a:b])
            runs += found[0]
            collapsed += found[1]
        yield pd.DataFrame({"runs": pd.Series(runs, dtype=object), "collapsed": pd.Series(collapsed, dtype=object)})


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``runs``, by start and then period, and ``collapsed``, each run cut to its first period.

    Columns of these names are replaced. One pass over whole texts, without a shuffle.
    """
    found = without(df, ["runs", "collapsed"]).withColumn("__found", _detected(text_or_empty(text)))
    return found.withColumns({"runs": F.col("__found.runs"), "collapsed": F.col("__found.collapsed")}).drop("__found")


def longest(runs: Column) -> Column:
    """The run of greatest length; among equals the one that starts first, then of the smallest period."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"),
                                             (-best["period"]).alias("period")))


def listed(runs: Column) -> Column:
    """Runs as text, one ``start,length,period`` a line."""
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


@F.pandas_udf(StringType())
def _repeated(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for seeds, texts in batches:
        out = []
        for h, text in zip(seeds.tolist(), texts.tolist()):
            words = words_of(text)
            n, g = len(words), int(h) // 10
            if h % 10 == 0 and n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                head = words[:a] + words[a:a + p] * (-(-(n - a) // p))
                text = b" ".join(head[:n]).decode("utf-8", "surrogatepass")
            out.append(text)
        yield pd.Series(out, dtype=object)


def repeat_tails(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Texts of a tenth of the ids with their last words replaced by repetitions, for trials of ``detect``.

    With h the crc32 of the id in decimals and g = h // 10, the words of a text with h % 10 = 0 from place
    a = g % n on repeat the first 1 + (n - a) // (3 + g % 8) of them. Texts of other ids, and of null ids, stay.
    """
    seed = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(1).cast("long"))
    return df.withColumn(text, _repeated(seed, text_or_empty(text)))

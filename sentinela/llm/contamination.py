"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may be found with up to ``n // PIECE`` edits. It is cut into one piece more
than that: however the edits fall, one piece stays whole. An automaton of all pieces scans each text
once; around every hit, Myers' bit-parallel distance decides whether the item is there. Pieces need
not cover the item, so each item is cut where its pieces are rare among all items' texts: an opening that
thousands of questions share costs no distance at each of its occurrences.

Texts and items are compared in lower case with runs of white space as one blank. An item without an
edit to spend must stand between word borders: "art" is not found in "part". Items are taken in blocks of
about ``BLOCK_CHARS`` characters, each scanned in a pass of its own whose result is written before
the next block is fetched, so the driver and the tasks hold one block whatever the benchmark's size.

Defined cases: null and blank items match nothing; short items are searched like all others; null texts
match nothing. Each text and item give at most one row, with the least distance of the places found.
Repeated rows give repeated results; items of one id count as one item.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sentinela.llm.tables import text_or_empty
from sentinela.staging import stage

PIECE, BLOCK_CHARS = 16, 2_000_000
# Shares of an item that may stay before its first piece or after its last.
MARGINS = ((0.0, 0.0), (0.125, 0.0), (0.25, 0.0), (0.0, 0.125), (0.0, 0.25), (0.125, 0.125))


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, margins: tuple[float, float] = MARGINS[0]) -> list[tuple[int, str]]:
    """Place and text of the pieces of which one must survive the error budget."""
    n = len(item) // PIECE + 1
    first = int(len(item) * margins[0])
    size = len(item) - first - int(len(item) * margins[1])
    cuts = [first + size * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def _automaton(words: dict[str, object]) -> ahocorasick.Automaton | None:
    if not words:
        return None
    out = ahocorasick.Automaton()
    for word, value in words.items():
        out.add_word(word, (word, value))
    out.make_automaton()
    return out


def rarest_pieces(texts: list[str]) -> list[list[tuple[int, str]]]:
    """For each item the cut whose pieces occur least often in all items."""
    choices = [[pieces(t, m) for m in MARGINS] if len(t) >= PIECE else [pieces(t)] for t in texts]
    counts = dict.fromkeys((piece for cuts in choices for cut in cuts for _, piece in cut), 0)
    automaton = _automaton(counts)
    for text in texts:
        for _, (piece, _) in automaton.iter(text):
            counts[piece] += 1
    return [min(cuts, key=lambda cut: sum(counts[piece] for _, piece in cut)) for cuts in choices]


def at_borders(text: str, start: int, end: int) -> bool:
    """Whether no word goes on across either end of a part of a text."""
    def inside(i: int) -> bool:
        return 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()

    return not inside(start) and not inside(end)


class Pattern:
    """An item, its error budget and its character masks."""

    def __init__(self, item_id: int, text: str):
        self.item_id, self.text, self.budget = item_id, text, len(text) // PIECE
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, window: str) -> int:
        """Least edit distance of the item to any part of ``window``."""
        m = len(self.text)
        top, full = 1 << (m - 1), (1 << m) - 1
        plus, minus, now = full, 0, m
        best, get = m, self.masks.get
        for c in window:
            same = get(c, 0)
            vertical = same | minus
            horizontal = (((same & plus) + plus) ^ plus) | same
            up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
            if up & top:
                now += 1
            elif down & top:
                now -= 1
                best = min(best, now)
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = down | (full & ~(vertical | up)), up & vertical
        return best


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [(item_id, plain(raw or "")) for item_id, raw in items]
        self.patterns = [Pattern(item_id, text) for item_id, text in texts if text]
        found: dict[str, list[tuple[int, int]]] = {}
        for number, cut in enumerate(rarest_pieces([p.text for p in self.patterns])):
            for start, piece in cut:
                found.setdefault(piece, []).append((number, start))
        self.automaton = _automaton(found)

    def find(self, raw: str) -> dict[int, int]:
        """Least distance of each item found in a text."""
        text = plain(raw)
        best: dict[int, int] = {}
        if self.automaton is None:
            return best
        tried: set[tuple[int, int]] = set()
        for end, (piece, places) in self.automaton.iter(text):
            for number, offset in places:
                pattern = self.patterns[number]
                if best.get(pattern.item_id) == 0:
                    continue
                start = end + 1 - len(piece) - offset
                if (number, start) in tried:
                    continue
                tried.add((number, start))
                if start >= 0 and text.startswith(pattern.text, start):
                    if pattern.budget or at_borders(text, start, start + len(pattern.text)):
                        best[pattern.item_id] = 0
                    continue
                if not pattern.budget:
                    continue
                window = text[max(0, start - pattern.budget):start + len(pattern.text) + pattern.budget]
                distance = pattern.distance(window)
                if distance <= min(pattern.budget, best.get(pattern.item_id, pattern.budget)):
                    best[pattern.item_id] = distance
        return best


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, a bounded block at a time."""
    total = items.agg(F.sum(F.length(text))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64(item_id, text), F.lit(n)) == i).select(item_id, text)
        yield [tuple(r) for r in part.collect() if r[1]]


def matches(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``item_id`` and ``distance`` of every item found in a text. No shuffle."""
    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, item_id long, distance int"
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text"))
    found = [stage(docs.mapInPandas(_scan(block), schema), "contamination") for block in blocks(items)]
    return reduce(DataFrame.union, found) if found else df.sparkSession.createDataFrame([], schema)


def _scan(block: list[tuple[int, str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(block)
        for batch in batches:
            hits = [
                (doc, item, distance) for doc, t in zip(batch["doc_id"], batch["text"])
                for item, distance in matcher.find(t).items()
            ]
            yield pd.DataFrame(hits, columns=["doc_id", "item_id", "distance"])

    return run


def _is_clean(text: Column, block: list[tuple[int, str]]) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(block)
        for batch in batches:
            yield pd.Series([not matcher.find(t) for t in batch], dtype=bool)

    return F.pandas_udf(run, "boolean")(text)


def drop_contaminated(df: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``df`` in which no item is found; its columns stay as they are. No shuffle.

    A benchmark of several blocks is gone through block by block, and what a block left is written
    before the next one is fetched.
    """
    before = None
    for block in blocks(items):
        if before is not None:
            df = stage(df.where(_is_clean(text_or_empty(text), before)), "without-block")
        before = block
    return df if before is None else df.where(_is_clean(text_or_empty(text), before))

"""BPE encoding and decoding by a pair occurrence index.

All distinct words of a batch lie one after the other in one symbol array. An index maps each
adjacent pair to every position it occurs at; the active ranks are applied in ascending order,
each to all its positions at once, and only the lists of the neighbouring pairs are updated.
This gives the same merges as going word by word, because in a vocabulary whose merges only use
symbols made by earlier merges (checked on loading) a merge never makes a pair of a lower rank.

White space always ends a word, so the unit of caching is what stands between white space.
Defined cases: a null text counts as empty, an empty text has no tokens, repeated rows give
repeated results, an unknown character has no token if the vocabulary has none for its bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from sentinela.llm.tables import CHARS_AT_ONCE, slices, text_or_empty, without

NO_RANK = np.iinfo(np.int64).max
# Entries of some 200 bytes that a Python worker keeps of chunks seen (two a chunk where texts are
# decoded too); the cache starts anew beyond it.
CACHE = 650_000
# Arrow splits at these controls as well, the tokenizer does not.
_ODD_SPACE = "[\\x1c-\\x1f]"
# Up to here the character classes are the same in all versions of Unicode.
_PLAIN_UP_TO = "ɏ"

FIELDS = {"n_tokens": "long", "ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if visible, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Encoder:
    """One vocabulary file: words with an end mark, bytes as letters, merges by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, bytes] = {}
        self.decoding = False
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(re.search(r"\s", s) for s in self.special):
            raise ValueError("special tokens with white space are not supported")
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self._at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self._words = regex.compile(splits[0]["pattern"]["Regex"])
        end = model["end_of_word_suffix"]
        letters = _byte_letters()
        self.letter_byte = {c: b for b, c in enumerate(letters)}
        self._inside = np.array([vocab[c] for c in letters], np.int64)
        self._last = np.array([vocab[c + end] for c in letters], np.int64)
        made: dict[int, int] = {}
        left, right, new = [], [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            if made.setdefault(c, rank) != rank or max(made.get(a, -1), made.get(b, -1)) >= rank:
                raise ValueError("a merge uses a symbol that only a later merge makes")
            left.append(a), right.append(b), new.append(c)
        self._left, self._right, self._new = (np.array(x, np.int64) for x in (left, right, new))
        keys = self._left << 32 | self._right
        self._order = np.argsort(keys)
        self._keys = keys[self._order]
        self._path = path

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._order[at], NO_RANK)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words in a row, and where each word's tokens start (one entry more at the end)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        if not len(raw):
            return np.empty(0, np.int64), np.zeros(len(words) + 1, np.int64)
        last = np.cumsum(lengths) - 1
        first = last - lengths + 1
        symbol = self._inside[raw]
        symbol[last] = self._last[raw[last]]
        follows = np.arange(1, len(raw) + 1)
        follows[last] = -1
        before = np.arange(-1, len(raw) - 1)
        before[first] = -1
        alive = np.ones(len(raw), bool)
        index: dict[int, array] = {}
        active: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            known = ranks != NO_RANK
            ranks, places = ranks[known], places[known]
            if len(ranks) < 24:
                for rank, place in zip(ranks.tolist(), places.tolist()):
                    if rank not in index:
                        index[rank] = array("q")
                        heapq.heappush(active, rank)
                    index[rank].append(place)
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(places, cuts)):
                if rank not in index:
                    index[rank] = array("q")
                    heapq.heappush(active, rank)
                index[rank].frombytes(part.tobytes())

        inner = np.flatnonzero(follows >= 0)
        add(self._ranks(symbol[inner], symbol[inner + 1]), inner)
        while active:
            rank = heapq.heappop(active)
            a, b, c = self._left[rank], self._right[rank], self._new[rank]
            # Entries may be doubled, and void where an earlier merge took their symbols.
            at = np.sort(np.frombuffer(index.pop(rank), np.int64))
            at = at[np.r_[True, at[1:] != at[:-1]]]
            at = at[alive[at] & (symbol[at] == a) & (follows[at] >= 0)]
            at = at[symbol[follows[at]] == b]
            if a == b and len(at) > 1:
                joined = np.r_[False, follows[at[:-1]] == at[1:]]
                place = np.arange(len(at))
                start = np.maximum.accumulate(np.where(joined, 0, place))
                at = at[(place - start) % 2 == 0]
            if not len(at):
                continue
            gone = follows[at]
            after = follows[gone]
            symbol[at], follows[at], alive[gone] = c, after, False
            right = after >= 0
            before[after[right]] = at[right]
            left = before[at]
            left = left[left >= 0]
            add(self._ranks(symbol[left], symbol[follows[left]]), left)
            add(self._ranks(symbol[at[right]], symbol[after[right]]), at[right])
        starts = np.r_[0, np.cumsum(alive)][np.r_[first, len(raw)]]
        return symbol[alive], starts

    def _pieces(self, chunk: str) -> list[bytes | int]:
        """Words as bytes, special tokens as their ids."""
        out: list[bytes | int] = []
        parts = self._at_special.split(chunk) if self._at_special and "<" in chunk else [chunk]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii() or part and max(part) <= _PLAIN_UP_TO:
                # No character of these blocks is changed by NFC, and lower case does not depend on context.
                out.extend([w.encode() for w in self._words.findall(part.lower())])
            elif part:
                # Letters outside the Latin blocks are classed by the tokenizer's own normaliser and splitter.
                library = _library(self._path)
                for word, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part)):
                    out.append(bytes([self.letter_byte[c] for c in word]))
        return out

    def learn(self, chunks: set[str]) -> None:
        """Put the ids (as bytes) and the decoded text of each chunk into the caches."""
        single: dict[str, bytes] = {}
        parts: dict[str, list[bytes | int]] = {}
        for chunk in chunks:
            # Most chunks are one word, or one word and one mark.
            if (word := chunk.lower()).isalpha() and max(chunk) <= _PLAIN_UP_TO:
                single[chunk] = word.encode()
            elif chunk[-1:] in (",", ".") and (word := chunk[:-1].lower()).isalpha() and max(chunk) <= _PLAIN_UP_TO:
                parts[chunk] = [word.encode(), chunk[-1].encode()]
            else:
                parts[chunk] = self._pieces(chunk)
        words = list({*single.values(), *(w for found in parts.values() for w in found if isinstance(w, bytes))})
        ids, starts = self.merge(words)
        packed, names, bounds = ids.astype("<u4").tobytes(), [self.names[i] for i in ids.tolist()], starts.tolist()
        packs: dict = {w: packed[4 * s:4 * e] for w, s, e in zip(words, bounds, bounds[1:])}
        packs |= {i: i.to_bytes(4, "little") for i in self.special.values()}
        self.ids.update({c: packs[w] for c, w in single.items()})
        self.ids.update({c: b"".join([packs[w] for w in found]) for c, found in parts.items()})
        if self.decoding:
            texts: dict = {
                w: " ".join(names[s:e]).encode() + b" " if e > s else b"" for w, s, e in zip(words, bounds, bounds[1:])
            }
            texts |= {i: self.names[i].encode() + b" " for i in self.special.values()}
            self.texts.update({c: texts[w] for c, w in single.items()})
            self.texts.update({c: b"".join([texts[w] for w in found]) for c, found in parts.items()})

    def encode(self, texts: list[str] | pa.Array, decode: bool = True) -> Iterator[tuple[memoryview, memoryview | None]]:
        """Ids as little-endian 32-bit integers, and the decoded text in UTF-8, of each text.

        The chunks of many texts are numbered by Arrow; only distinct ones are looked up in Python.
        """
        self.decoding = self.decoding or decode
        for start, end in slices(texts.to_pylist() if isinstance(texts, pa.Array) else texts, 12 * CHARS_AT_ONCE):
            split = _chunks(pa.array(texts[start:end], pa.large_string()))
            bounds = np.asarray(split.offsets).tolist()
            coded = split.values.dictionary_encode()
            chunks = coded.dictionary.to_pylist()
            if new := set(chunks) - (self.texts if decode else self.ids).keys():
                if (len(self.ids) + len(new)) * (1 + self.decoding) > CACHE:
                    self.ids.clear(), self.texts.clear()
                    new = {*chunks}
                self.learn(new)
            ids = _joined(map(self.ids.__getitem__, chunks), coded.indices, bounds)
            names = _joined(map(self.texts.__getitem__, chunks), coded.indices, bounds) if decode else repeat(None)
            # Every name is followed by a blank; the last one is not part of the text.
            yield from zip(ids, (n and n[:-1] for n in names) if decode else names)

    def decode(self, ids: bytes) -> str:
        """Token names joined by a blank, as a tokenizer without a decoder does."""
        return " ".join(self.names[i] for i in np.frombuffer(ids, "<u4").tolist() if i in self.names)


def _chunks(texts: pa.Array) -> pa.Array:
    """List of what stands between white space; where Arrow's white space is not the tokenizer's, by pattern."""
    if not pc.any(pc.match_substring_regex(texts, _ODD_SPACE)).as_py():
        return pc.utf8_split_whitespace(texts)
    return pa.array([regex.findall(r"\S+", t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))


def _joined(values: Iterator[bytes], indices: pa.Array, bounds: list[int]) -> Iterator[memoryview]:
    """For each range of ``bounds``, the values that its indices name, in a row."""
    if not len(indices):
        return repeat(memoryview(b""), len(bounds) - 1)
    taken = pa.array(list(values), pa.large_binary()).take(indices)
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64)[bounds].tolist()
    view = memoryview(data)
    return (view[s:e] for s, e in zip(at, at[1:]))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder, with its cache, for all tasks of a Python worker."""
    return Encoder(path)


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoded(text: Column, vocabulary: str, fields: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> Column:
    """Struct of the asked ``FIELDS`` for a text column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = encoder(vocabulary)
        decode = bool({"decoded", "decoded_sha256"} & {*fields})
        make = {
            "n_tokens": lambda ids, text: len(ids) // 4,
            "ids": lambda ids, text: bytes(ids),
            "decoded": lambda ids, text: str(text, "utf-8"),
            "ids_sha256": lambda ids, text: hashlib.sha256(ids).hexdigest(),
            "decoded_sha256": lambda ids, text: hashlib.sha256(text).hexdigest(),
        }
        makers = [make[f] for f in fields]
        for batch in batches:
            rows = [[m(ids, text) for m in makers] for ids, text in coder.encode(batch.tolist(), decode)]
            yield pd.DataFrame(rows, columns=list(fields))

    schema = ", ".join(f"{f} {FIELDS[f]}" for f in fields)
    return F.pandas_udf(run, schema)(text)


def encode(df: DataFrame, vocabulary: str, fields: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
           text: str = "text") -> DataFrame:
    """Add the asked fields to ``df``; columns of these names are replaced. No shuffle."""
    kept = without(df, [f for f in fields if f.lower() != text.lower()])
    found = kept.withColumn("__bpe", encoded(text_or_empty(text), vocabulary, fields))
    return found.select(*[F.col(f"`{c}`") for c in kept.columns], *[F.col(f"__bpe.{f}").alias(f) for f in fields])


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Text of a binary column of little-endian 32-bit token ids; null gives null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoder(vocabulary)
        for batch in batches:
            yield pd.Series([None if b is None else coder.decode(b) for b in batch], dtype=object)

    return df.withColumn(to, F.pandas_udf(run, "string")(F.col(ids)))

"""URL filters by a bit-parallel wildcard automaton.

Glob rules (``*`` any bytes, ``?`` one byte) are packed one after the other into words of 64 bits,
one bit for each literal byte. All URLs of a batch advance together, byte by byte: shift, take in the
starting bits, keep what the byte allows, and keep where a ``*`` lets a state stay. That runs all
rules at once, whatever their number of words.

A URL is matched in canonical form: a dot, the host, a separator that no text holds, and the path.
So a rule ``host/path`` is the glob ``*.host<separator>/path*``, which fits the host and its
subdomains and paths that start with the rule's.

Defined cases: a null URL or one without ``://`` has an empty host and path, which no rule fits; of
several fitting rules the longest wins, of those the first in alphabetical order; a URL that no rule
fits gets the default. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sentinela.llm.tables import without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A byte that UTF-8 never uses.
SEPARATOR = b"\xff"
BYTES_AT_ONCE = 1 << 24


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    @property
    def glob(self) -> bytes:
        host, _, path = self.text.partition("/")
        return b"*." + host.encode() + SEPARATOR + b"/" + path.encode() + b"*"


class Automaton:
    """Shift-And over packed globs."""

    def __init__(self, globs: list[bytes]):
        tokens = [[part for part in g.split(b"*")] for g in globs]
        bits = sum(sum(map(len, t)) for t in tokens)
        words = max(1, -(-bits // 64))
        self.allowed, self.loops = np.zeros((256, words), np.uint64), np.zeros(words, np.uint64)
        self.first, self.floating, self.anchored = (np.zeros(words, np.uint64) for _ in range(3))
        # For each glob the bit of its last byte, or -1 if it consists of stars or is empty.
        self.last, self.any = np.full(len(globs), -1), np.array([g.strip(b"*") == b"" and g != b"" for g in globs], bool)
        at = 0
        for g, parts in enumerate(tokens):
            start = at
            for k, part in enumerate(parts):
                for byte in part:
                    word, bit = at // 64, np.uint64(1 << (at % 64))
                    self.allowed[slice(None) if byte == ord("?") else byte, word] |= bit
                    at += 1
                if k + 1 < len(parts) and at > start:
                    self.loops[(at - 1) // 64] |= np.uint64(1 << ((at - 1) % 64))
            if at > start:
                word, bit = start // 64, np.uint64(1 << (start % 64))
                self.first[word] |= bit
                (self.floating if globs[g].startswith(b"*") else self.anchored)[word] |= bit
                self.last[g] = at - 1

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Which globs fit which texts, as a matrix of booleans."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        ends = np.sort(lengths)
        state = np.zeros((len(texts), len(self.loops)), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(lengths.max(initial=0))):
            # Texts are in falling order of length, so those still running are the first ones.
            n = len(texts) - int(np.searchsorted(ends, i, side="right"))
            now = state[:n]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            shifted &= ~self.first
            shifted |= self.floating | self.anchored if i == 0 else self.floating
            state[:n] = (shifted & self.allowed[data[starts[:n] + i]]) | (now & self.loops)
        fits = np.zeros((len(texts), len(self.last)), bool)
        for g, bit in enumerate(self.last):
            found = (state[:, bit // 64] >> np.uint64(bit % 64) & one).astype(bool) if bit >= 0 else self.any[g]
            fits[order, g] = found
        return fits


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first ``://``, as far as the first ``/``, ``?`` or ``#``, and on to ``?`` or ``#``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def judge(df: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``; input columns of these names are replaced. No shuffle."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = Automaton([r.glob for r in ranked])
        names = np.array([*(r.text for r in ranked), None], dtype=object)
        verdicts = np.array([*(r.verdict for r in ranked), default], dtype=object)
        for hosts, paths in batches:
            urls = [b"." + h.encode() + SEPARATOR + p.encode() for h, p in zip(hosts, paths)]
            best = np.full(len(urls), len(ranked))
            start = size = 0
            for i, u in enumerate([*urls, b""]):
                if i == len(urls) or size and size + len(u) > BYTES_AT_ONCE:
                    fits = automaton.run(urls[start:i])
                    found = fits.any(axis=1)
                    best[start:i][found] = fits.argmax(axis=1)[found]
                    start, size = i, 0
                size += len(u)
            yield pd.DataFrame({"rule": names[best], "verdict": verdicts[best]})

    host, path = parts(F.col(f"`{url}`"))
    kept = without(df, ["host", "path", "rule", "verdict"])
    found = df.select(*[F.col(f"`{c}`") for c in kept.columns], host.alias("host"), path.alias("path"))
    found = found.withColumn("__found", F.pandas_udf(run, "rule string, verdict string")("host", "path"))
    return found.select(*[F.col(f"`{c}`") for c in kept.columns], "host", "path", "__found.rule", "__found.verdict")

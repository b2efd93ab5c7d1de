"""Texts of a batch as one array of code points, for work on all of them at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Odd multipliers of the rolling hash and of its final mixing.
ROLL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(texts: list[str], gap: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by ``gap`` blanks, and where each text starts."""
    joined = (" " * gap).join(texts) + " " * gap
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + gap
    return codes, np.cumsum(lengths) - lengths


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(ROLL), -1, 1 << 64)
    up, down = np.full(n, ROLL), np.full(n, np.uint64(inverse))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.r_[False, inside, False].view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Rolling:
    """Hashes of any spans of one array: the same characters give the same hash wherever they stand."""

    def __init__(self, codes: np.ndarray):
        size = 1 << max(16, int(len(codes)).bit_length())
        self.up, self.down = _powers(size)
        self.sums = np.r_[np.uint64(0), np.cumsum(codes.astype(np.uint64) * self.up[: len(codes)], dtype=np.uint64)]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * ROLL
    return h ^ (h >> np.uint64(32))

"""Texts of one Arrow batch as flat numpy arrays: bytes, words, lines, and hashes of them.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes of words and lines are polynomials modulo 2**64, taken
from running sums and mixed afterwards, so no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_HEAD = np.ones(256, bool)  # first byte of a code point
IS_HEAD[0x80:0xC0] = False

_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser constants of splitmix64)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def per_row(values: np.ndarray, starts: np.ndarray, total: int | None = None) -> np.ndarray:
    """Sums of the slices of ``values`` that begin at ``starts`` (sorted, ``len(rows) + 1`` borders)."""
    sums = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "biu" else values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[starts[1:]] - sums[starts[:-1]]


class Texts:
    """``data``: all bytes; ``at``: byte borders of the rows, one more than rows."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        buffers = column.buffers()
        borders = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
        raw = np.frombuffer(buffers[2], np.uint8)[borders[0] : borders[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
        self.at = borders - borders[0]
        self.data = LOWER[raw] if lower else raw
        self.rows = len(column)
        self._sums = None

    def _hash_sums(self) -> tuple[np.ndarray, np.ndarray]:
        if self._sums is None:
            up, down = _powers(len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + U(1)) * up[:-1], out=sums[1:])
            self._sums = sums, down
        return self._sums

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums, down = self._hash_sums()
        return mix((sums[end] - sums[start]) * down[start])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and word borders of the rows."""
        inside = ~IS_SPACE[self.data]
        edge = np.empty(len(inside) + 1, bool)
        edge[0] = len(inside) and inside[0]
        edge[-1] = len(inside) and inside[-1]
        edge[1:-1] = inside[1:] != inside[:-1]
        begin = inside.copy()
        if len(inside):
            begin[1:] &= ~inside[:-1]
            cuts = self.at[1:-1]
            cuts = cuts[cuts < len(inside)]
            begin[cuts] = inside[cuts]  # a row's first byte starts a word of its own
        start = np.flatnonzero(begin)
        stop = inside.copy()
        if len(inside):
            stop[:-1] &= ~inside[1:]
            cuts = self.at[1:-1]
            cuts = cuts[cuts > 0] - 1
            stop[cuts] = inside[cuts]
        end = np.flatnonzero(stop) + 1
        return start, end, np.searchsorted(start, self.at)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all lines split at LF (an empty row has one empty line), and line borders of the rows."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.at[:-1], breaks + 1]), kind="stable")
        end = np.sort(np.concatenate([self.at[1:], breaks]), kind="stable")
        counts = np.searchsorted(breaks, self.at[1:]) - np.searchsorted(breaks, self.at[:-1]) + 1
        borders = np.zeros(self.rows + 1, np.int64)
        np.cumsum(counts, out=borders[1:])
        return start, end, borders


def row_of(borders: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(borders) - 1), np.diff(borders))


def windows(hashes: np.ndarray, borders: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows, the row and the first word of each."""
    n = np.maximum(np.diff(borders) - size + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + borders[:-1][rows]
    combined = np.zeros(len(first), np.uint64)
    for k in range(size):
        combined = combined * U(0xD6E8FEB86659FD93) + hashes[first + k]
    return mix(combined), rows, first

"""Words of whole texts as 64-bit hashes, computed with NumPy on the UTF-8 bytes of Arrow columns.

Texts are handled in pieces of about ``PIECE`` bytes (whole documents, so one document longer than that
is a piece of its own). The hash of a word depends on its bytes only, so it is the same everywhere.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_U = np.uint64
BASE, INVERSE = _U(0x9E3779B97F4A7C13), _U(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def separators(kind: str) -> np.ndarray:
    """256 flags: which bytes part words. ``space``: ASCII white space; ``symbol``: every ASCII byte but
    digits and letters."""
    table = np.zeros(256, bool)
    if kind == "space":
        table[list(SPACES)] = True
    else:
        table[:128] = [not chr(b).isalnum() for b in range(128)]
    return table


SPACE, SYMBOL = separators("space"), separators("symbol")
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(max(n, PIECE * 2), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits (in place)."""
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Words:
    """Words of some documents: ``h`` their hashes, ``start``/``end`` their bytes in ``data``; the words of
    document i are ``first[i]:first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, parts: np.ndarray, lower: bool):
        self.data = data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~parts[data]
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        bounds = offsets[1:-1]
        bounds = bounds[(bounds > 0) & (bounds < n)]  # a word never runs on into the next document
        begins[bounds] = inside[bounds + 1]
        ends[bounds - 1] = inside[bounds]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        power, inverse = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * power[:n], out=total[1:])
        self.h = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each position on, and which positions have that many left in
        their document (the hashes of others mean nothing)."""
        n = len(self.h)
        if n < size:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        power, inverse = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.h * power[:n], out=total[1:])
        h = np.zeros(n, np.uint64)
        h[:n - size + 1] = mix((total[size:] - total[:n - size + 1]) * inverse[:n - size + 1])
        last = np.repeat(self.first[1:], np.diff(self.first))
        return h, np.arange(size, n + size) <= last

    def bytes(self, i: int, j: int) -> bytes:
        """Text from word i to the end of word j - 1."""
        return self.data[self.start[i]:self.end[j - 1]].tobytes()


def pieces(column: pa.Array, size: int = PIECE):
    """``(first row, last row + 1, bytes, offsets)`` of runs of rows of about ``size`` bytes; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def word_pieces(column: pa.Array, parts: np.ndarray = SPACE, lower: bool = False, size: int = PIECE):
    for a, b, data, offsets in pieces(column, size):
        yield a, b, Words(data, offsets, parts, lower)


def tidy() -> None:
    """Gives freed memory back, so that a worker waiting for its next task holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def flat(lists) -> np.ndarray:
    return np.concatenate(lists) if len(lists) else np.zeros(0)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start[i], ..., start[i] + count[i] - 1 of every i, one after the other."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return np.arange(total, dtype=np.int64) + shift

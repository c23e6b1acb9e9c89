"""Vectorized reading of text columns inside Arrow tasks: words, shingles and byte windows of whole texts.

Everything works on the UTF-8 bytes of a batch. Rows are taken in slices of about ``SLICE_BYTES``, so the memory of a task
follows the slice and the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


LOWER = _lower_ascii()


def word_table(excluded: list[tuple[int, int]]) -> np.ndarray:
    """Byte classes of a word pattern ``[^...]+`` over lower-cased text: 0 where no word may be, else the byte."""
    table = LOWER.copy()
    for first, last in excluded:
        table[first : last + 1] = 0
    return table


#: ``[^\x20\x09-\x0D]+``; byte 0 counts as a word byte and is folded onto 255, which UTF-8 never uses.
SPACED_WORDS = word_table([(0x20, 0x20), (0x09, 0x0D)])
SPACED_WORDS[0] = 255
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing
ALNUM_WORDS = word_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and their len + 1 offsets; null is the empty text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return data[lo:hi], offsets - lo


def row_slices(offsets: np.ndarray, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``budget`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; those of a slice are kept."""
    kept = _POWERS.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, SLICE_BYTES), base)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        if len(kept) <= 4 * SLICE_BYTES:
            _POWERS[int(base)] = kept
    return kept[:n]


class Words:
    """The words of a slice: ``hash``, ``start``, ``end`` (byte offsets) and ``row``; ``first[r]:first[r+1]`` are row r's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        symbols = table[data]
        inside = symbols != 0
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        before[edges] = False
        after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hashes(symbols)

    def _hashes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        lo = 0
        while lo < len(out):  # whole words of about a slice at a time
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + SLICE_BYTES, side="right")))
            at, stop = self.start[lo], self.end[hi - 1]
            sums = np.zeros(stop - at + 1, np.uint64)
            np.multiply(symbols[at:stop], powers(BASE, stop - at), out=sums[1:])
            np.cumsum(sums, out=sums)
            begin = self.start[lo:hi] - at
            out[lo:hi] = mix((sums[self.end[lo:hi] - at] - sums[begin]) * powers(BASE_INVERSE, stop - at)[begin])
            lo = hi
        return out

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each run of ``size`` words inside one row."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 : size - 1 + n])
        return combine(self.hash, at, size), at


def combine(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run ``hashes[a : a + size]``; order and length count."""
    total = np.full(len(at), np.uint64(size))
    for step in range(size):
        total *= _ODD
        total += hashes[at + step]
    return mix(total)


def integers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)

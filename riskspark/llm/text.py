"""Words and shingles of whole text columns, computed on the bytes of an Arrow array.

A batch of texts is one byte buffer with offsets, so splitting and hashing run as numpy passes over the buffer
instead of a loop over words. Words are runs of bytes other than space and ``\\t \\n \\v \\f \\r``. Hashes are
64-bit: a polynomial over the bytes of a word, mixed; a shingle mixes the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
"""Texts are handled in slices of about this many bytes, which bounds the memory of the numpy passes."""

SLICE_ROWS = 512

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept for the next slice of a similar size."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        step = np.full(max(n, 1), base, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if n <= 2 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive rows: byte bounds in ``data``, row number and hash, in reading order."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    @property
    def n_rows(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        """Hashes of the words, which stand in reading order; bytes are read in runs of whole words."""
        out, first = np.empty(len(self.start), np.uint64), 0
        while first < len(out):
            lo = self.start[first]
            last = max(first + 1, int(np.searchsorted(self.end, lo + SLICE_BYTES, "right")))
            start, end = self.start[first:last] - lo, self.end[first:last] - lo
            n = int(end[-1])
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data[lo : lo + n].astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
            poly = (sums[end] - sums[start]) * _power(_INVERSE, n + 1)[start]
            out[first:last] = mix(poly + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            first = last
        return out

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows).astype(np.int64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; a null row is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, at, data = texts.buffers()
    if len(texts) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about ``limit`` bytes; a long text stays whole."""
    for at in range(0, len(texts), SLICE_ROWS):
        data, offsets = buffers(texts.slice(at, SLICE_ROWS))
        first, n = 0, len(offsets) - 1
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(n, max(last, first + 1))
            yield at + first, at + last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def pieces(texts: pa.Array, run: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Like ``slices``, but a text longer than ``limit`` comes in several pieces under its row: cut after white space, or
    inside a word that is longer than a piece at a multiple of ``run`` bytes from its start."""
    limit = limit // run * run
    for lo, hi, data, offsets in slices(texts, limit):
        at = 0
        while len(data) - at > limit:
            blank = np.flatnonzero(_SPACE[data[at : at + limit]])
            end = at + (int(blank[-1]) + 1 if len(blank) else limit)
            yield lo, hi, data[at:end], np.array([0, end - at])
            at = end
        yield (lo, hi, data[at:], np.array([0, len(data) - at])) if at else (lo, hi, data, offsets)


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of each row; ``lower`` maps A-Z to a-z and leaves every other byte."""
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, offsets, start, end, row)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words; a row with fewer words gives its whole sequence once."""
    h, row = words.hashes(), words.row
    n = len(h)
    counts = words.counts()
    k1, k2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    whole = np.flatnonzero(row[: max(0, n - size + 1)] == row[size - 1 :]) if n >= size else np.zeros(0, np.int64)
    acc = np.full(len(whole), size, np.uint64)
    for j in range(size):
        acc = mix(acc * k1 + h[whole + j]) + k2
    short = np.flatnonzero((counts > 0) & (counts < size))
    first = np.searchsorted(row, short)
    tail = counts[short].astype(np.uint64)
    for j in range(size - 1):
        more = counts[short] > j
        tail[more] = mix(tail[more] * k1 + h[first[more] + j]) + k2
    return np.concatenate([row[whole], short]), np.concatenate([acc, tail])


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row and by the hash read as a signed number, as the JVM compares it."""
    h = h.view(np.int64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from the concatenated values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

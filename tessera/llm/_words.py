"""Words of UTF-8 text as arrays: bounds, digests and rolling digests of word windows.

Everything works on the bytes of an Arrow string column, many documents at a time, in
slices of documents so that memory follows the slice (or the one longest document), not
the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice of documents has, unless its one document has more.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ np.uint64(seed & MASK)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words of a slice of documents, in order. first[d]:first[d + 1] are those of document d."""

    data: np.ndarray  # bytes of the slice
    start: np.ndarray  # byte bounds of each word
    end: np.ndarray
    first: np.ndarray
    rows: slice  # the documents' rows in the batch

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def digests(self, seed: int = 0) -> np.ndarray:
        """A 64-bit digest of each word's bytes."""
        n = self.end - self.start
        if not len(n):
            return np.zeros(0, np.uint64)
        powers = np.cumprod(np.full(int(n.max()) + 1, _BASE, np.uint64))
        inside = np.zeros(len(self.data) + 1, np.int64)
        inside[self.start] += 1
        inside[self.end] -= 1
        keep = np.cumsum(inside[:-1]).astype(bool)
        letters = self.data[keep].astype(np.uint64) + np.uint64(1)
        at = np.zeros(len(n), np.int64)
        np.cumsum(n[:-1], out=at[1:])
        place = np.arange(len(letters)) - np.repeat(at, n)
        sums = np.add.reduceat(letters * powers[place], at)
        return mix(sums + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), seed)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_utf8())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a string column, some documents at a time."""
    at, data = text_buffers(column)
    row = 0
    while row < len(at) - 1:
        to = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        part, bounds = data[at[row] : at[to]], at[row : to + 1] - at[row]
        word = ~_SPACE[part]
        before = np.zeros(len(part), bool)
        before[1:] = word[:-1]
        before[bounds[:-1][bounds[:-1] < len(part)]] = False  # a document begins: nothing before it
        start = np.flatnonzero(word & ~before)
        after = np.zeros(len(part), bool)
        after[:-1] = word[1:]
        ends = bounds[1:]
        after[ends[ends > 0] - 1] = False
        end = np.flatnonzero(word & ~after) + 1
        yield Words(part, start, end, np.searchsorted(start, bounds), slice(row, to))
        row = to


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A rolling digest of ``n`` consecutive word digests for each start (by doubling)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, done, block, size, left = None, 0, h, 1, n
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                out = block if out is None else out[: len(h) - done - size + 1] * _power(size) + block[done : done + len(h) - done - size + 1]
                done += size
            left >>= 1
            if left:
                m = len(block) - size
                block = block[:m] * _power(size) + block[size : size + m]
                size *= 2
    return out[: len(h) - n + 1]


def sliding(values: np.ndarray, n: int, least: bool = True) -> np.ndarray:
    """The least (or greatest) of ``n`` consecutive values for each start."""
    f = np.minimum if least else np.maximum
    size, block = 1, values
    while size * 2 <= n:
        block = f(block[: len(block) - size], block[size:])
        size *= 2
    rest = n - size
    return f(block[: len(block) - rest], block[rest:]) if rest else block


def whole(words: Words, n: int) -> np.ndarray:
    """For each window start of :func:`windows`: does the window lie in one document?"""
    count = len(words.start) - n + 1
    if count <= 0:
        return np.zeros(0, bool)
    doc = words.doc
    return doc[:count] == doc[n - 1 :]

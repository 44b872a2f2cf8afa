"""Wavelet matrix: a sequence of token ids as bit planes with rank and select.

Plane by plane, from the highest bit, the sequence is partitioned stably into the
entries whose bit is 0 and those whose bit is 1. The bits of all planes, with a count of
ones before each block, answer access, rank and select in a step for each plane. The ids
of a shard are first numbered in order, so a shard has no more planes than its own
alphabet needs.

One shard is one file: a head with lengths, then compressed parts (alphabet, document
bounds and ids, planes). All numbers are little-endian.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import zstandard

MAGIC = b"TSWM1\n"
#: Bits of a block of the rank directory.
BLOCK = 512
#: Entries that are partitioned in one step.
_STEP = 1 << 15
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _steps(n: int):
    return ((i, min(i + _STEP, n)) for i in range(0, n, _STEP))


def _build(codes: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed planes and their numbers of zeros. Each plane is partitioned step by step,
    by index: an index array of a step stays in the processor's cache."""
    planes, zeros = [], []
    for level in range(levels - 1, -1, -1):
        bits = (codes & codes.dtype.type(1 << level)).astype(bool)
        planes.append(np.packbits(bits))
        zeros.append(len(bits) - int(np.count_nonzero(bits)))
        after, z, o = np.empty_like(codes), 0, zeros[-1]
        for a, b in _steps(len(codes) if level else 0):
            part, bit = codes[a:b], bits[a:b]
            one = part[np.flatnonzero(bit)]
            zero = part[np.flatnonzero(~bit)]
            after[z : z + len(zero)] = zero
            after[o : o + len(one)] = one
            z, o = z + len(zero), o + len(one)
        codes = after
    return planes, zeros


@dataclass
class Shard:
    """An opened shard. Positions count tokens of the shard from 0."""

    length: int
    alphabet: np.ndarray  # sorted token ids
    zeros: list[int]  # entries with bit 0, by plane
    planes: list[np.ndarray]  # packed bits, by plane
    bounds: np.ndarray  # position of each document's first token, then the length
    ids: list[int | None]  # documents' ids

    @cached_property
    def _ranks(self) -> list[np.ndarray]:
        """Ones before each block, by plane."""
        out = []
        for plane in self.planes:
            ones = _POPCOUNT[np.pad(plane, (0, -len(plane) % (BLOCK // 8)))].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
            out.append(np.concatenate([[0], np.cumsum(ones)]))
        return out

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, byte = i // BLOCK, i // 8
        bits = self.planes[plane]
        n = int(self._ranks[plane][block]) + int(_POPCOUNT[bits[block * BLOCK // 8 : byte]].sum())
        return n + (bin(int(bits[byte]) >> (8 - i % 8)).count("1") if i % 8 else 0)

    def access(self, i: int) -> int:
        """The token at a position."""
        if not 0 <= i < self.length:
            raise IndexError(i)
        code = 0
        for p in range(len(self.planes)):
            ones = self._ones(p, i)
            if self.planes[p][i // 8] >> (7 - i % 8) & 1:
                code, i = code * 2 + 1, self.zeros[p] + ones
            else:
                code, i = code * 2, i - ones
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _range(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        levels = len(self.planes)
        for p in range(levels):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if code >> (levels - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in lo:hi."""
        code = self._code(token)
        if code is None:
            return 0
        a, b = self._range(code, lo, self.length if hi is None else hi)
        return b - a

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) bit of a value in a plane."""
        ranks = self._ranks[plane]
        seen = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(seen, k, "right")) - 1
        bits = np.unpackbits(self.planes[plane][block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(seen[block])])

    def select(self, token: int, k: int) -> int:
        """The position of a token's k-th occurrence (from 0)."""
        code = self._code(token)
        lo, hi = self._range(code, 0, self.length) if code is not None else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for p in range(len(self.planes) - 1, -1, -1):
            bit = code >> (len(self.planes) - 1 - p) & 1
            at = self._select_bit(p, bit, at - self.zeros[p] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All tokens, in order: the partitions are undone from the lowest plane up."""
        n, levels = self.length, len(self.planes)
        dtype = np.uint16 if levels <= 16 else np.uint32
        low = np.zeros(n, dtype)
        for p in range(levels - 1, -1, -1):
            bits = np.unpackbits(self.planes[p], count=n).view(bool)
            here, z, o = np.empty(n, dtype), 0, self.zeros[p]
            for a, b in _steps(n):
                zero, one = np.flatnonzero(~bits[a:b]), np.flatnonzero(bits[a:b])
                part = here[a:b]
                part[zero] = low[z : z + len(zero)]
                part[one] = low[o : o + len(one)] | dtype(1 << (levels - 1 - p))
                z, o = z + len(zero), o + len(one)
            low = here
        return self.alphabet[low] if n else np.zeros(0, np.uint32)


def encode(tokens: np.ndarray, bounds: np.ndarray, ids: list[int | None]) -> bytes:
    """The file of a shard: tokens of documents ``ids``, document d at bounds[d]:bounds[d + 1]."""
    present = np.zeros(int(tokens.max()) + 1 if len(tokens) else 0, bool)
    present[tokens] = True
    alphabet = np.flatnonzero(present).astype(np.uint32)
    levels = max(1, int(len(alphabet) - 1).bit_length())
    number = np.zeros(len(present), np.uint16 if levels <= 16 else np.uint32)
    number[alphabet] = np.arange(len(alphabet))
    planes, zeros = _build(number[tokens], levels)
    pack = zstandard.ZstdCompressor(level=1).compress
    known = np.array([i is not None for i in ids], np.uint8)
    parts = [alphabet.astype("<u4"), np.diff(bounds, prepend=0).astype("<i8"), np.array([i or 0 for i in ids], "<i8"), known, *planes]
    blobs = [pack(p.tobytes()) for p in parts]
    head = json.dumps({"length": len(tokens), "zeros": zeros, "parts": [len(b) for b in blobs]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *blobs])


def decode(file: bytes) -> Shard:
    if file[: len(MAGIC)] != MAGIC:
        raise ValueError("not a wavelet shard")
    at = len(MAGIC) + 4
    size = struct.unpack("<I", file[at - 4 : at])[0]
    head, at = json.loads(file[at : at + size]), at + size
    unpack, parts = zstandard.ZstdDecompressor().decompress, []
    for n in head["parts"]:
        parts.append(unpack(file[at : at + n]))
        at += n
    known = np.frombuffer(parts[3], np.uint8)
    ids = [int(i) if k else None for i, k in zip(np.frombuffer(parts[2], "<i8"), known, strict=True)]
    return Shard(head["length"], np.frombuffer(parts[0], "<u4"), head["zeros"], [np.frombuffer(p, np.uint8) for p in parts[4:]], np.cumsum(np.frombuffer(parts[1], "<i8")), ids)

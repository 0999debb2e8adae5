"""Words, lines and word windows of Arrow text columns, found over whole byte buffers with numpy.

Texts are UTF-8; all word patterns used here are classes of bytes, so that byte positions are
enough. A batch is worked through in slices of whole documents (`slices`), which bounds memory
by the slice size, or by a single document if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))

#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], to be used after lower-casing
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE, name: str = "base") -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(name)
    if known is None or len(known) < n:
        known = np.full(max(n, 4096), base, U64)
        known[0] = 1
        _powers[name] = known = np.cumprod(known, dtype=U64)
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if at else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold at most so many bytes, or one document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


@dataclass
class Words:
    """Words of a slice in text order. `doc` counts from 0 in the slice; `offsets` are its documents' byte bounds."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n_docs: int
    mask: np.ndarray
    prefix: np.ndarray | None = None

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges."""
        if self.prefix is None:
            n = len(self.data)
            self.prefix = np.zeros(n + 1, U64)
            np.cumsum((self.data.astype(U64) + U64(1)) * powers(n), out=self.prefix[1:])
        value = (self.prefix[end] - self.prefix[start]) * powers(len(self.data) + 1, INVERSE, "inverse")[start]
        return mixed(value + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    """Longest runs of bytes of a kind that don't cross documents."""
    base = offsets[0]
    data, offsets = data[base : offsets[-1]], offsets - base
    if lower:
        data = LOWER[data]
    n, filled = len(data), offsets[:-1] < offsets[1:]
    mask = kind[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    start, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, offsets, start, end, doc, len(offsets) - 1, mask)


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one document, and the index of each window's first word."""
    if len(hashes) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(len(hashes) - n + 1, U64)
    for i in range(n):
        total = total * BASE + hashes[i : len(hashes) - n + 1 + i]
    first = np.flatnonzero(doc[: len(total)] == doc[n - 1 :])
    return mixed(total[first] + U64(n)), first


def first_of(values: np.ndarray) -> np.ndarray:
    """Flags of the first row of each run of equal values."""
    flags = np.ones(len(values), bool)
    flags[1:] = values[1:] != values[:-1]
    return flags

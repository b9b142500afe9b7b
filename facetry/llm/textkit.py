"""Whole-batch text work in numpy: words, pre-tokens, hashes, distinct values and a growing cache.

Everything works on slices of a few MB of UTF-8, whatever the size of an Arrow batch, so memory is bounded by the
slice or, where one is longer, by the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: For operators that hold some thirty times a slice, beside an executor's full heap.
SMALL_SLICE = 1 << 20


def returning(run):
    """`run` over batches, after which the worker gives what it freed back to the system: it may stay for other stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


#: Words longer than this are hashed and segmented one at a time.
LONG = 48

_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_CLASS[0x20] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MUL)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of consecutive rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run outside [\\x20\\x09-\\x0D]; none crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = _CLASS[data] > 0
    before, after = np.empty_like(blank), np.empty_like(blank)
    before[0], before[1:] = True, blank[:-1]
    after[-1], after[:-1] = True, blank[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    start = np.flatnonzero(before & ~blank)
    end = np.flatnonzero(after & ~blank) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    size = end - start
    h = size.astype(np.uint64) * _MUL
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    by_size = np.minimum(size, LONG + 1)[order]
    n_long = int(np.searchsorted(-by_size, -LONG, "left"))
    live, at, acc = order[n_long:], start[order[n_long:]], np.zeros(len(order) - n_long, np.uint64)
    sizes = by_size[n_long:]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k, "left"))  # those longer than k
        acc[:m] = acc[:m] * _MUL + _BYTE[data[at[:m] + k]]
    h[live] ^= acc
    for i in order[:n_long]:
        import hashlib

        h[i] = np.uint64(int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little"))
    return mix64(h)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each, distinct values, position of the first of each)."""
    codes, values = pd.factorize(h.view(np.int64))
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, np.asarray(values).view(np.uint64), first


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, spaces, row): each word or other white-space character with the count of spaces before it.

    The first of a row has one space more, its dummy prefix; spaces at a row's end stand alone with an empty span.
    An empty row has none.
    """
    ws, we, wr = words(data, offsets)
    other = np.flatnonzero(_CLASS[data] == 2)
    rows = np.flatnonzero(offsets[1:] > offsets[:-1])
    ends = offsets[1:][rows]
    start = np.concatenate([ws, other, ends])
    end = np.concatenate([we, other + 1, ends])
    row = np.concatenate([wr, np.searchsorted(offsets, other, "right") - 1, rows])
    order = np.argsort(start * 2 + np.concatenate([np.ones(len(ws) + len(other), np.int64), np.zeros(len(ends), np.int64)]), kind="stable")
    start, end, row = start[order], end[order], row[order]
    if not len(start):
        return start, end, start, row
    first = np.empty(len(start), bool)
    first[0], first[1:] = True, row[1:] != row[:-1]
    before = np.concatenate([[0], end[:-1]])
    before[first] = offsets[row[first]]
    spaces = start - before + first
    keep = (end > start) | (spaces > 0)
    return start[keep], end[keep], spaces[keep], row[keep]


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, spaces: np.ndarray, row: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens, those with no space between them made one where joins[last byte, first byte] says that a piece may reach over."""
    own = np.ones(len(start), bool)
    near = np.flatnonzero(spaces == 0)  # never the first of a row, and never empty
    own[near[joins[data[end[near - 1] - 1], data[start[near]]]]] = False
    first = np.flatnonzero(own)
    last = np.append(first[1:], len(start)) - 1
    return start[first], end[last], spaces[first], row[first]


def csr_take(values: np.ndarray, ptr: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """values[ptr[c]:ptr[c+1]] for each c of codes, one after the other."""
    size = ptr[codes + 1] - ptr[codes]
    total = int(size.sum())
    where = np.repeat(ptr[codes] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
    return values[where]


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


class Table:
    """Open addressing from 64-bit keys to 0, 1, 2, ... in order of insertion, a batch at a time."""

    def __init__(self, most: int = 1 << 21):
        self.most, self.n = most, 0
        self.mask = (1 << 16) - 1
        self.keys, self.vals = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 if absent."""
        out = np.full(len(keys), -1, np.int32)
        live, at = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(live):
            v = self.vals[at]
            hit = (v >= 0) & (self.keys[at] == keys[live])
            out[live[hit]] = v[hit]
            go = (v >= 0) & ~hit
            live, at = live[go], (at[go] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Adds distinct keys that are absent."""
        if (self.n + len(keys)) * 2 > self.mask:
            held = np.flatnonzero(self.vals >= 0)
            old_k, old_v = self.keys[held], self.vals[held]
            while (self.n + len(keys)) * 2 > self.mask:
                self.mask = self.mask * 2 + 1
            self.keys, self.vals = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
            self._put(old_k, old_v)
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        live, at = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(live):
            free = self.vals[at] < 0
            self.vals[at[free]] = vals[live[free]]
            self.keys[at[free]] = keys[live[free]]
            stay = self.vals[at] != vals[live]
            live, at = live[stay], (at[stay] + 1) & self.mask


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray, spaces: np.ndarray | None = None, mark: int = 0xFF) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, size): each span as a row of bytes, `spaces` marks first, padded with 0; for spans that fit in LONG."""
    lead = np.zeros(len(start), np.int64) if spaces is None else spaces
    size = lead + end - start
    width = int(size.max()) if len(size) else 0
    col = np.arange(width)
    where = start[:, None] + col - lead[:, None]
    inside = (col >= lead[:, None]) & (col < size[:, None])
    out = np.zeros((len(start), width), np.uint8)
    out[inside] = data[where[inside]]
    out[col < lead[:, None]] = mark
    return out, size

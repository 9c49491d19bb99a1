"""Whole texts as numpy arrays: words, their hashes and shingles of many texts at once.

Texts stay in Arrow's own buffers. A slice holds whole texts, half a megabyte together; a longer
text is a slice of its own. Hashes are of 64 bits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 19
U = np.uint64
_BLOCK = 1 << 14
#: Spans up to this many bytes are hashed together, longer ones each on its own.
_SHORT = 64
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers; long arrays part by part, so that what is between stays in the cache."""
    if x.ndim == 1 and len(x) > _BLOCK:
        out = np.empty_like(x)
        for at in range(0, len(x), _BLOCK):
            out[at : at + _BLOCK] = mix(x[at : at + _BLOCK])
        return out
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache
def byte_table(kind: str) -> np.ndarray:
    """Which bytes are in words. spaced: all but ASCII white space; alnum: lower-case letters, digits, non-ASCII."""
    t = np.ones(256, bool)
    if kind == "spaced":
        t[[0x20, *range(9, 14)]] = False
    else:
        t[:0x80] = False
        t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = True
    return t


@lru_cache
def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about limit bytes."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def windows8(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place of data, and at its end, as one number; zeros follow the data."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", wide, 0, (1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span: its size, then eight bytes at a time, each mixed in by a bijection of the state.

    Nothing here is a polynomial of the bytes, so texts that agree in their sums of powers are told apart."""
    size = end - start
    eight = windows8(data)
    h = size.astype(U) * U(0xD6E8FEB86659FD93)
    live = np.flatnonzero((size > 0) & (size <= _SHORT))
    at, left = start[live], size[live]
    while len(live):
        w = eight[at]
        w &= _LOW[np.minimum(left, 8)]
        h[live] = mix(h[live] ^ w) * U(0x9E3779B97F4A7C15)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]], 29)
    return mix(h)


class Words:
    """Words of the texts lo..hi: start, end (bytes within the slice), row (from 0); data: the slice's bytes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lo: int, hi: int, kind: str, lower: bool = True):
        base = offs[lo]
        raw = data[base : offs[hi]]
        self.rows = hi - lo
        self.at = offs[lo : hi + 1] - base
        self.data = lower_table()[raw] if lower else raw
        inside = byte_table(kind)[raw]
        n = len(raw)
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.at[:-1], self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=self.rows)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and their rows, in order; a text of fewer words is one shingle, one of none has none."""
    h, first, count = words.hashes(), words.first, words.count
    n = len(h)
    out = np.zeros(max(0, n - k + 1), U)
    for j in range(k):
        out += h[j : n - k + 1 + j] * U((0xA0761D6478BD642F * (2 * j + 3) * (j + 1) | 1) & 0xFFFFFFFFFFFFFFFF)
    row = words.row[: len(out)]
    ok = words.row[k - 1 :] == row if len(out) else np.zeros(0, bool)
    out, row = mix(out)[ok], row[ok]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), U)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] += h[first[short[has]] + j] * U((0xE7037ED1A0B428DB * (2 * j + 3) * (j + 1) | 1) & 0xFFFFFFFFFFFFFFFF)
        extra = mix(extra + count[short].astype(U))
        out, row = np.concatenate([out, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    return out, row


def distinct_sorted(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row in ascending order, their rows, and the bounds of the rows."""
    at = np.searchsorted(row, np.arange(rows + 1))
    h = h.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, row, np.searchsorted(row, np.arange(rows + 1))


def sums_by(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds, modulo 2**64."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


class HashIndex:
    """Byte strings to the numbers 0, 1, ... in order of insertion: 64-bit keys by open addressing, and the strings, to compare them."""

    def __init__(self, bits: int = 16):
        self.n, self.bits = 0, bits
        self.keys, self.vals = np.zeros(1 << bits, U), np.zeros(1 << bits, np.int32)
        self.data, self.at = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(h), -1, np.int32), np.arange(len(h))
        mask, pos = U(len(self.keys) - 1), h & U(len(self.keys) - 1)
        while len(todo):
            k = self.keys[pos]
            hit = k == h[todo]
            out[todo[hit]] = self.vals[pos[hit]]
            on = ~hit & (k != 0)
            todo, pos = todo[on], (pos[on] + U(1)) & mask
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 for unknown ones."""
        return self._find(np.where(h == 0, U(1), h))

    def add(self, new: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Inserts distinct keys that are not there yet, with their strings, which are spans of data."""
        new = np.where(new == 0, U(1), new)
        vals = np.arange(self.n, self.n + len(new), dtype=np.int32)
        self.n += len(new)
        size = end - start
        ends = np.cumsum(size)
        self.data = np.concatenate([self.data, data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)]])
        self.at = np.concatenate([self.at, self.at[-1] + ends])
        if self.n * 2 > len(self.keys):
            old = self.keys != 0
            keys, nums = self.keys[old], self.vals[old]
            self.bits = int(self.n * 2).bit_length() + 1
            self.keys, self.vals = np.zeros(1 << self.bits, U), np.zeros(1 << self.bits, np.int32)
            self._put(keys, nums)
        self._put(new, vals)

    def _put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        mask = U(len(self.keys) - 1)
        pos = keys & mask
        while len(keys):
            free = self.keys[pos] == 0
            self.keys[pos[free]] = keys[free]
            won = free & (self.keys[pos] == keys)
            self.vals[pos[won]] = vals[won]
            keys, vals, pos = keys[~won], vals[~won], (pos[~won] + U(1)) & mask

    def same(self, number: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the spans of data are, byte for byte, the strings of these numbers."""
        ours, theirs = windows8(self.data), windows8(data)
        left, a, b = end - start, self.at[number], start
        out = self.at[number + 1] - a == left
        live = np.flatnonzero(out & (left > 0))
        a, b, left = a[live], b[live], left[live]
        while len(live):
            differ = (ours[a] ^ theirs[b]) & _LOW[np.minimum(left, 8)] != 0
            out[live[differ]] = False
            more = ~differ & (left > 8)
            live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
        return out

"""Texts cut into pieces that a byte-level BPE tokenizer treats independently.

The tokenizer's pattern splits before each run of white space, and after a run of one white-space
character other than a blank. So a text in which every run of white space has length 1 may be cut at
these places, and each piece be tokenized alone and only once. Other texts, and texts that hold a
special token's string, are left whole."""

from __future__ import annotations

import numpy as np

from .textnum import HashIndex, span_hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
#: First two bytes of white space outside ASCII, as big-endian numbers: U+0085, U+00A0, U+1680, U+20xx, U+3000.
_WIDE = (0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380)


class Pieces:
    """Pieces of the texts lo..hi; whole: rows that must not be cut."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lo: int, hi: int, special: bytes):
        base = int(offs[lo])
        raw = data[base : offs[hi]]
        self.data, self.at, self.rows = raw, offs[lo : hi + 1] - base, hi - lo
        n = len(raw)
        space = _SPACE[raw]
        whole = np.zeros(self.rows, bool)

        def flag(positions: np.ndarray) -> None:
            whole[np.searchsorted(self.at[:-1], positions, "right") - 1] = True

        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        starts = space | edge[:n]
        if n:
            flag(np.flatnonzero(space[1:] & space[:-1]) + 1)
            flag(np.flatnonzero((raw >= 0x1C) & (raw <= 0x1F)))
            starts[1:] |= space[:-1] & (raw[:-1] != 0x20)
        if n > 2:
            pair = raw[:-1].astype(np.uint16) << 8 | raw[1:]
            wide = np.flatnonzero(np.isin(pair, _WIDE) & (raw[:-1] >= 0xC2))
            if len(wide):
                before = wide[(wide > 0)]
                flag(before[space[before - 1] & (raw[before - 1] != 0x20)])
                for size in (2, 3):
                    after = wide[wide + size < n]
                    last = raw[after + size - 1]
                    blank = (size == 2) | (raw[after] != 0xE2) | (last <= 0x8A) | np.isin(last, (0xA8, 0xA9, 0xAF, 0x9F))
                    flag(after[space[after + size] & blank])
        blob = raw.tobytes() if special else b""
        at = blob.find(special) if special else -1
        while at >= 0:
            flag(np.array([at]))
            at = blob.find(special, at + 1)
        self.whole = np.flatnonzero(whole)
        start = np.flatnonzero(starts)
        row = np.searchsorted(self.at[:-1], start, "right") - 1
        end = np.append(start[1:], n)
        if len(self.whole):
            keep = ~whole[row]
            start, end, row = start[keep], end[keep], row[keep]
        self.start, self.end, self.row = start, end, row
        self.count = np.bincount(row, minlength=self.rows)

    def text(self, row: int) -> str:
        return self.data[self.at[row] : self.at[row + 1]].tobytes().decode("utf-8", "replace")

    def numbered(self, index: HashIndex, strings: bool = True) -> tuple[np.ndarray, list[str]]:
        """Each piece's number in the index, and the strings of the numbers that this call added to it (none if they are not asked for).

        Every piece is compared, byte for byte, with the string of its number; a text with a piece that only has the
        key of another joins those that are left whole."""
        h = span_hashes(self.data, self.start, self.end)
        found = index.find(h)
        miss = np.flatnonzero(found < 0)
        texts: list[str] = []
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            known, at = index.n, miss[first]
            index.add(new, self.data, self.start[at], self.end[at])
            found[miss] = known + back.astype(np.int32)
            blob = self.data.tobytes() if strings else b""
            texts = [] if not strings else [blob[a:b].decode("utf-8", "replace") for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]
        same = index.same(found, self.data, self.start, self.end)
        if not same.all():
            self.whole = np.union1d(self.whole, self.row[~same])
            keep = ~np.isin(self.row, self.whole)
            self.start, self.end, self.row, found = self.start[keep], self.end[keep], self.row[keep], found[keep]
            self.count = np.bincount(self.row, minlength=self.rows)
        return found, texts

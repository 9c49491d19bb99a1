"""Token counts (operator 8): byte-pair merging with a heap and a linked list, counting merges only.

A pretoken's count is its number of initial symbols (bytes) minus the merges made; no identifiers are
emitted. Each distinct piece of text is merged once in a worker and its count kept; the kept table is
emptied at MOST_KEPT pieces, which costs time and changes no result."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map
from .pieces import Pieces
from .textnum import HashIndex, buffers, slices

MOST_KEPT = 1_000_000
#: The published pattern of this tokenizer family (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class BytePairs:
    """The merges of a byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.of_byte = [vocab[c] for c in byte_letters()]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
            self.made.append(vocab[a + b])
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.kept: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """Tokens of one pretoken."""
        n = len(data)
        if n < 2:
            return n
        sym = [self.of_byte[b] for b in data]
        rank, made = self.rank.get, self.made
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [r << 40 | i for i in range(n - 1) if (r := rank(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 40, top & 0xFFFFFFFFFF
            j = right[i]
            if sym[i] < 0 or j >= n or rank(sym[i] << 32 | sym[j]) != r:
                continue  # one of the pair has been merged meanwhile
            merges += 1
            sym[i], sym[j] = made[r], -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank(sym[i] << 32 | sym[k])) is not None:
                    heapq.heappush(heap, r << 40 | i)
            h = left[i]
            if h >= 0 and (r := rank(sym[h] << 32 | sym[i])) is not None:
                heapq.heappush(heap, r << 40 | h)
        return n - merges

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total, kept = 0, self.kept
        for word in self.pattern.findall(text):
            n = kept.get(word)
            if n is None:
                if len(kept) >= MOST_KEPT // 2:
                    kept.clear()
                n = self.merged(word.encode("utf-8"))
                if len(word) < 64:
                    kept[word] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string in it is one token, as the library has it by default."""
        if self.at_special is None:
            return self.plain(text)
        parts = self.at_special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


class _Counter:
    def __init__(self, path: str):
        self.pairs = BytePairs(path)
        self.reset()

    def reset(self) -> None:
        self.index, self.counts = HashIndex(), np.zeros(0, np.int64)

    def slice(self, data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> np.ndarray:
        special = self.pairs.special
        if len(special) > 1:  # pieces are cut at one special string only
            return np.array([self.pairs.count(data[a:b].tobytes().decode("utf-8")) for a, b in zip(offs[lo:hi], offs[lo + 1 : hi + 1], strict=True)], np.int64)
        p = Pieces(data, offs, lo, hi, special[0].encode() if special else b"")
        if self.index.n > MOST_KEPT:
            self.reset()
        number, new = p.numbered(self.index)
        if new:
            self.counts = np.concatenate([self.counts, np.fromiter(map(self.pairs.plain, new), np.int64, len(new))])
        out = np.bincount(p.row, self.counts[number], minlength=p.rows).astype(np.int64) if len(number) else np.zeros(p.rows, np.int64)
        for row in p.whole.tolist():
            out[row] = self.pairs.count(p.text(row))
        return out


_counters: dict[str, _Counter] = {}


def _task(path: str, limit: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    counter = _counters.setdefault(path, None) or _Counter(path)
    _counters[path] = counter

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = buffers(batch.column(1))
        n = np.concatenate([counter.slice(data, offs, lo, hi) for lo, hi in slices(offs)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    vocabulary: path of a byte-level BPE file that every executor can open (a vocabulary that is installed
    with the workers). A null text counts as empty: 0 bytes, 0 tokens. A null key stays null; repeated rows
    give repeated rows; columns besides key and text are ignored, whatever their names; an empty table
    gives an empty result. One narrow map: no shuffle, and a lost executor costs its own tasks only.
    The file has at most one special string in its added tokens checked for the fast cut; more than one
    sends each text through the whole-text path."""
    return arrow_map(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), partial(_task, vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Benchmark decontamination (operator 6): Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive words of the items. For patterns of m words, the text is looked at
only where a block of its last two words may end a pattern: a shift table, by block hash, holds how
far the block stands from the end of any pattern, and the search moves on by that; 0 leads to the bucket of patterns
with this suffix block, which are compared with the text word by word and then byte by byte. Numpy moves
many places of the text at once (lanes); each lane is a search of its own.

Items are broadcast in chunks of bounded size; each task holds one compiled chunk at a time, so a
benchmark of any size works, at a pass over a batch for each chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .textnum import U, Words, buffers, slices, span_hashes

#: Bytes of items in a broadcast. Compiled they take about sixty times as much, for every window is kept as text.
CHUNK_BYTES = 4 << 20
LANE = 256
_A = U(0x9FB21C651E98DF25)


def _block(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return (h[at - 1] * _A + h[at] if width == 2 else h[at]) * U(0xC2B2AE3D27D4EB4F)


class Patterns:
    """All patterns of one length: hashes of their words, and each one's bytes and items."""

    def __init__(self, words: np.ndarray, texts: list[bytes], items: list[list[int]]):
        self.words, self.texts, self.items = words, texts, items
        n, self.m = words.shape
        self.width = min(2, self.m)
        bits = max(12, int(8 * n * self.m).bit_length())
        self.down = U(64 - bits)
        self.shift = np.full(1 << bits, self.m - self.width + 1, np.int64)
        for end in range(self.width - 1, self.m):
            key = _block(words.T, np.array([end]), self.width)[0]
            np.minimum.at(self.shift, (key >> self.down).astype(np.int64), self.m - 1 - end)
        suffix = _block(words.T, np.array([self.m - 1]), self.width)[0]
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def search(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last words of windows that may be patterns, and those patterns' numbers; equal in all word hashes."""
        n, m = len(h), self.m
        lane = np.arange(m - 1, n, LANE)
        stop = np.minimum(lane + LANE, n)
        hits = []
        while len(lane):
            step = self.shift[(_block(h, lane, self.width) >> self.down).astype(np.int64)]
            zero = step == 0
            if zero.any():
                hits.append(lane[zero])
                step[zero] = 1
            lane = lane + step
            on = lane < stop
            lane, stop = lane[on], stop[on]
        at = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        key = _block(h, at, self.width)
        lo, hi = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        size = hi - lo
        at = np.repeat(at, size)
        which = self.order[np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)]
        for j in range(m):
            same = h[at - j] == self.words[which, m - 1 - j]
            at, which = at[same], which[same]
        return at, which


def compiled(items: list[tuple[str, str]], window: int) -> tuple[list[Patterns], list[str]]:
    """Patterns of the items by length. items: (id, text), texts without null."""
    names = sorted({i for i, _ in items})
    number = {x: i for i, x in enumerate(names)}
    found: dict[int, dict[bytes, set[int]]] = {}
    data, offs = buffers(pa.array([t for _, t in items], pa.string()))
    for lo, hi in slices(offs):
        w = Words(data, offs, lo, hi, "alnum")
        blob = w.data.tobytes()
        for row in range(hi - lo):
            a, b = int(w.first[row]), int(w.first[row + 1])
            m = min(window, b - a)
            words = [blob[s:e] for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]
            for i in range(b - a - m + 1 if m else 0):
                found.setdefault(m, {}).setdefault(b" ".join(words[i : i + m]), set()).add(number[items[lo + row][0]])
    out = []
    for m, texts in sorted(found.items()):
        ordered = sorted(texts)
        blob = b" ".join(ordered)
        raw = np.frombuffer(blob, np.uint8)
        cut = np.flatnonzero(raw == 0x20)
        h = span_hashes(raw, np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(raw)]]))
        out.append(Patterns(h.reshape(-1, m), ordered, [sorted(texts[t]) for t in ordered]))
    return out, names


#: Compiled chunks that a worker keeps. With more, they are taken in groups of so many, once for each batch of documents.
RESIDENT = 2
_compiled: dict[tuple, tuple[list[Patterns], list[str]]] = {}


def _chunk(broadcast, window: int) -> tuple[list[Patterns], list[str]]:
    key = (broadcast._jbroadcast.id() if broadcast._jbroadcast is not None else broadcast._path, window)
    if key not in _compiled:
        while len(_compiled) >= RESIDENT:
            del _compiled[next(iter(_compiled))]
        _compiled[key] = compiled(broadcast.value, window)
        if broadcast._jbroadcast is None:
            del broadcast._value  # a worker's copy of the items, which it could read again from its file
    return _compiled[key]


def _covered(spans: list[tuple[int, int]]) -> int:
    """Places in any of the spans (both ends included)."""
    total, upto = 0, -1
    for a, b in sorted(spans):
        total += max(0, b - max(a, upto + 1) + 1)
        upto = max(upto, b)
    return total


def _task(chunks: list, window: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = buffers(batch.column(1))
        count = np.zeros(batch.num_rows, np.int64)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for group in range(0, max(1, len(chunks)), RESIDENT):
            for lo, hi in slices(offs):
                w = Words(data, offs, lo, hi, "alnum")
                count[lo:hi] = w.count
                h = w.hashes()
                blob = None
                for c in chunks[group : group + RESIDENT]:
                    patterns, names = _chunk(c, window)
                    for p in patterns:
                        if len(h) < p.m:
                            continue
                        at, which = p.search(h)
                        inside = w.row[at] == w.row[at - p.m + 1]
                        for last, k in zip(at[inside].tolist(), which[inside].tolist(), strict=True):
                            if blob is None:
                                blob = w.data.tobytes()
                            first = last - p.m + 1
                            if b" ".join([blob[s:e] for s, e in zip(w.start[first : last + 1].tolist(), w.end[first : last + 1].tolist(), strict=True)]) == p.texts[k]:
                                row = int(w.row[last])
                                spans.setdefault(lo + row, []).append((first - int(w.first[row]), last - int(w.first[row])))
                                items.setdefault(lo + row, set()).update([names[i] for i in p.items[k]])
        hit = np.array([_covered(spans[i]) if i in spans else 0 for i in range(batch.num_rows)], np.int64)
        found = [sorted(items.get(i, ())) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(hit), pa.array(found, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

    return run


def _chunks(bench: DataFrame, text: str, key: str, chunk_bytes: int) -> Iterator[list[tuple[str, str]]]:
    held, size = [], 0
    rows = bench.select(bench[key].cast("string").alias("k"), bench[text].alias("t")).where("k is not null and t is not null")
    for k, t in rows.toLocalIterator():
        held.append((k, t))
        size += len(t)
        if size >= chunk_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def broadcast_items(bench: DataFrame, text: str = "text", key: str = "item_id", chunk_bytes: int = CHUNK_BYTES) -> list:
    """The items with an id and a text, as broadcasts of about chunk_bytes each."""
    return [bench.sparkSession.sparkContext.broadcast(c) for c in _chunks(bench, text, key, chunk_bytes)]


def occurrences(docs: DataFrame, bench: DataFrame, window: int = 10, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit, items (ids as strings, sorted), contaminated.

    Words are runs of ASCII letters (A-Z lower-cased), digits and all characters beyond ASCII. Each item's
    windows of `window` words are looked for (an item of fewer words is one window, one without words has none),
    in whole texts. n_hit: words inside any occurrence. Null texts have no words; items with a null id or text
    take no part; items that repeat an id count once; repeated rows of docs are repeated. Columns besides those
    named are ignored. Empty tables give empty results, or no hits. One narrow map: nothing is shuffled."""
    chunks = broadcast_items(bench, item_text, item_key, chunk_bytes)
    out = arrow_map(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), partial(_task, chunks, window), "doc_id long, n_words long, n_hit long, items array<string>")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def contamination_digest(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """occurrences() with the items as their number and the sha256 of their comma-joined ids."""
    joined = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return occurrences(docs, bench, **options).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined.alias("items_sha256"), "contaminated")


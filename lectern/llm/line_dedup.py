"""Line dedup (operator 10): fuzzy lines by MinHash, exact verification, distributed union-find, one line kept.

A line is what stands between line ends; lines of white space only are kept and compared with nothing.
Equal lines are one class. A class is its set of shingles of GRAM characters (a shorter line is one shingle); two
classes are linked when their sets' Jaccard similarity is at least 0.8. Candidates share a band of ROWS
minimum hashes; with 14 bands of 5 a pair at 0.8 is a candidate with probability 0.996, at 0.85 with 0.9999.
Lines of 96 distinct shingles or more take their minima over the quarter of shingles with hashes divisible by 4, lines of
under 128 over all (those between do both, so both sides of a pair have a signature in common; so do longer ones with under
SMALL shingles in the quarter, so none is without bands). Repeats within a line count once. Every candidate
is verified on the whole lines' sets of shingles, by 64-bit hashes of these. Of each component the first line in order of
documents stays, in all its documents but the first equal lines go too."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, rows_in, stored
from .linking import Packs, connected, element_rows, parts_for, possible, shared_buckets, sketches
from .textnum import U, buffers, distinct_sorted, mix, slices, span_hashes

GRAM = 8
BANDS, ROWS = 14, 5
SEEN = 1_000_000
#: Classes in a bucket beyond which those without a possible partner are sought first.
HOT = 16
#: Lines that have a shingle, up to which they are compared by it.
RARE = 24
#: A long line with fewer distinct shingles than this in the quarter takes its minima over all shingles, too.
SMALL = 8
#: Shingles at the beginning of a line that tell, where enough of them are distinct, that it is long and its quarter not small.
BEGINNING = 160
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True
_BLANKS = " \t\n\x0b\x0c\r"


class Lines:
    """The lines of the texts lo..hi that are not blank: start, end (bytes), row, number within the text, hash."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lo: int, hi: int):
        self.data = raw = data[offs[lo] : offs[hi]]
        at = offs[lo : hi + 1] - offs[lo]
        self.rows, self.at = hi - lo, at
        ends = np.flatnonzero(raw == 0x0A)
        filled = at[:-1][np.diff(at) > 0]
        start = np.sort(np.concatenate([filled, ends + 1]))
        start = start[np.concatenate([[True], start[1:] != start[:-1]])] if len(start) else start
        start = start[start < len(raw)]
        stop = np.append(start[1:], len(raw)) if len(start) else start
        row = np.searchsorted(at[:-1], start, "right") - 1
        first = np.searchsorted(start, at[:-1])
        self.number = np.arange(len(start)) - first[row]
        end = stop - (raw[stop - 1] == 0x0A)
        ink = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(~_BLANK[raw], out=ink[1:])
        keep = ink[end] > ink[start]
        self.start, self.end, self.row, self.number = start[keep], end[keep], row[keep], self.number[keep]

    @cached_property
    def hash(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


@lru_cache
def _codes() -> np.ndarray:
    """Hashes of all code points."""
    return mix(np.arange(1, 0x110001, dtype=U))


def characters(lines: Lines, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lines of GRAM characters or more, in order; and bounds of the lines (shorter: nothing)."""
    code = np.frombuffer(lines.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    place = np.zeros(len(lines.data) + 1, np.int64)
    np.cumsum((lines.data & 0xC0) != 0x80, out=place[1:])
    a, b = place[lines.start[which]], place[lines.end[which]]
    x = _codes()[code]
    for k in (1, 2, 4):
        right = x[k:]
        x = x[:-k] * U((0x9E3779B97F4A7C15 * (2 * k + 1) | 1) & 0xFFFFFFFFFFFFFFFF) if len(x) > k else x[:0]
        x += right
    n = np.maximum(b - a - GRAM + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    pick = np.arange(int(bounds[-1])) + np.repeat(a - bounds[:-1], n)
    return mix(x[pick]), bounds


def bands(h: np.ndarray, bounds: np.ndarray, salt: np.ndarray, n_bands: int = BANDS, n_rows: int = ROWS) -> np.ndarray:
    """Band signatures (lines x bands) of non-empty runs of hashes, each with its salt."""
    low = (h >> U(32)).astype(np.uint32)
    n = len(bounds) - 1
    own = np.empty_like(low)
    least = np.empty((n_bands * n_rows, n), np.uint32)
    for i, (a, b) in enumerate(np.random.default_rng(29).integers(0, 1 << 31, (n_bands * n_rows, 2)).tolist()):
        np.bitwise_xor(low, np.uint32(b), out=own)
        np.multiply(own, np.uint32(2 * a + 1), out=own)
        np.minimum.reduceat(own, bounds[:-1], out=least[i])
    key = salt.astype(U) * U(1000) + np.arange(n_bands, dtype=U)[:, None]
    for row in range(n_rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + least[row::n_rows].astype(U) + U(1))
    return np.ascontiguousarray(key.T)


def _places_task() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = buffers(batch.column(1))
        for lo, hi in slices(offs):
            x = Lines(data, offs, lo, hi)
            mark = span_hashes(x.data, x.at[:-1], x.at[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].take(pa.array(x.row)), pa.array(mark[x.row].astype(np.int64)), pa.array(x.number.astype(np.int32)), pa.array(x.hash.astype(np.int64))], ["doc_id", "mark", "line", "class"])

    return run


def _runs(h: np.ndarray, bounds: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the lines `own`, and their bounds."""
    if len(own) == len(bounds) - 1:
        return h, bounds
    size = bounds[own + 1] - bounds[own]
    at = np.concatenate([[0], np.cumsum(size)])
    return h[np.arange(int(at[-1])) + np.repeat(bounds[own] - at[:-1], size)], at


def _scales(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct shingles each line has, and how many in the quarter; of lines with 128 and SMALL of them or more, these may be less, down to that many."""
    size = np.diff(bounds)
    n, parts = size.copy(), np.zeros(len(size), np.int64)
    long = size >= 96  # only these can have 96 distinct shingles
    known = np.flatnonzero(size > BEGINNING)
    if len(known):
        x = np.sort(h[bounds[known][:, None] + np.arange(BEGINNING)], axis=1)
        new = np.ones(x.shape, bool)
        np.not_equal(x[:, 1:], x[:, :-1], out=new[:, 1:])
        n[known], parts[known] = new.sum(1), (new & ((x & U(3)) == 0)).sum(1)
        long[known] = (n[known] < 128) | (parts[known] < SMALL)
    long = np.flatnonzero(long)
    if len(long):
        g, at = _runs(h, bounds, long)
        g, row, at = distinct_sorted(g, np.repeat(np.arange(len(long)), np.diff(at)), len(long))
        n[long], parts[long] = np.diff(at), np.bincount(row[(g & U(3)) == 0], minlength=len(long))
    return n, parts


def _bands_task(n_bands: int, n_rows: int, parts: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    seen: set[int] = set()
    packs = Packs(parts)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = buffers(batch.column(0))
        for lo, hi in slices(offs):
            x = Lines(data, offs, lo, hi)
            new = []
            for i, h in enumerate(x.hash.tolist()):
                if h not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(h)
                    new.append(i)
            which = np.array(new, np.int64)
            h, bounds = characters(x, which)
            n, parts = _scales(h, bounds)
            # A long line with a small quarter emits both, so it shares a salt with each line near its scale.
            all_, some = np.flatnonzero((n > 0) & ((n < 128) | (parts < SMALL))), np.flatnonzero((n >= 96) & (parts > 0))
            if not len(all_) + len(some):
                continue
            quarter = np.flatnonzero((h & U(3)) == 0)
            (g, at), (q, to) = _runs(h, bounds, all_), _runs(h[quarter], np.searchsorted(quarter, bounds), some)
            sig = bands(np.concatenate([g, q]), np.concatenate([at, to[1:] + at[-1]]), np.repeat([1, 2], [len(all_), len(some)]), n_bands, n_rows)
            yield from packs.add(sig.ravel(), np.repeat(x.hash[which[np.concatenate([all_, some])]], n_bands))
        yield from packs.flush()

    return run


def _line_texts(x: Lines, which: np.ndarray) -> pa.Array:
    """The lines `which` as strings, cut from the bytes of all; bytes that are no UTF-8 are replaced."""
    if not len(which):
        return pa.array([], pa.string())
    edges = np.stack([x.start, x.end], 1).ravel().astype(np.int32)  # every other span is a line
    spans = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(x.data))
    try:
        spans.validate(full=True)
    except pa.ArrowInvalid:
        blob = x.data.tobytes()
        return pa.array([blob[a:b].decode("utf-8", "replace") for a, b in zip(x.start[which].tolist(), x.end[which].tolist(), strict=True)], pa.string())
    return spans.take(pa.array(2 * which))


def _texts_task() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = buffers(batch.column(0))
        for lo, hi in slices(offs):
            x = Lines(data, offs, lo, hi)
            _, first = np.unique(x.hash, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.hash[first].astype(np.int64)), _line_texts(x, first)], ["class", "line"])

    return run


def _sketch_task() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = buffers(batch.column(1))
        for lo, hi in slices(offs):
            x = Lines(data, offs, lo, hi)
            h, bounds = characters(x, np.arange(hi - lo))
            h, row, at = distinct_sorted(h, np.repeat(np.arange(hi - lo), np.diff(bounds)), hi - lo)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.maximum(np.diff(at), 1)), pa.array(sketches(h, row, hi - lo), pa.binary()), part.column(1)], ["class", "n", "sketch", "line"])

    return run


def _elements_task() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cls = np.asarray(batch.column(0))
        data, offs = buffers(batch.column(1))
        for lo, hi in slices(offs):
            x = Lines(data, offs, lo, hi)
            h, bounds = characters(x, np.arange(hi - lo))
            h, _, at = distinct_sorted(h, np.repeat(np.arange(hi - lo), np.diff(bounds)), hi - lo)
            yield element_rows(h, at, cls[lo:hi])

    return run


def _line_sets(column: pa.Array) -> list[np.ndarray]:
    """Hashes of the shingles of each line, ascending; a line shorter than a shingle has the line's own."""
    out: list[np.ndarray] = []
    data, offs = buffers(column)
    for lo, hi in slices(offs):
        x = Lines(data, offs, lo, hi)
        h, bounds = characters(x, np.arange(hi - lo))
        h, _, at = distinct_sorted(h, np.repeat(np.arange(hi - lo), np.diff(bounds)), hi - lo)
        out += [h[a:b] if b > a else x.hash[i : i + 1] for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]
    return out


def _verify_task(percent: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            a, b = np.asarray(part.column(0)), np.asarray(part.column(1))
            # Each line of the part once.
            cls, first = np.unique(np.concatenate([a, b]), return_index=True)
            texts = pa.concat_arrays([part.column(2), part.column(3)]).take(pa.array(first))
            sets = _line_sets(texts)
            keep = []
            for i, j in zip(np.searchsorted(cls, a).tolist(), np.searchsorted(cls, b).tolist(), strict=True):
                s, t = sets[i], sets[j]
                both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def kept_lines(docs: DataFrame, percent: int = 80, n_bands: int = BANDS, n_rows: int = ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The lines that stay, of those that are not blank: doc_id, mark (a hash of the text), line (from 0).

    One line of each component is kept: that of the smallest doc_id (nulls last), then mark, then line."""
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    places = stored(arrow_map(rows, _places_task, "doc_id long, mark long, line int, class long"), "places")
    parts = parts_for(docs.sparkSession, places.count() * n_bands)
    packs = arrow_map(rows.select("text"), partial(_bands_task, n_bands, n_rows, parts), "part int, data binary")
    near, large = shared_buckets(packs, parts, HOT)
    in_buckets = stored(near.select(F.explode(F.array("a", "b")).alias("class")).unionAll(large.select("class")).distinct(), "classes")
    texts = arrow_map(rows.select("text"), _texts_task, "class long, line string")
    texts = rows_in(texts, in_buckets, "class").dropDuplicates(["class"]).select("class", "line")
    texts = stored(arrow_map(texts, _sketch_task, "class long, n long, sketch binary, line string"), "lines")

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = texts.select(F.col("class").alias("a"), F.col("line").alias("x")), texts.select(F.col("class").alias("b"), F.col("line").alias("y"))
        near = possible(pairs, texts, percent)
        return arrow_map(near.join(x, "a").join(y, "b").select("a", "b", "x", "y"), partial(_verify_task, percent), "a long, b long")

    def elements(sets: DataFrame) -> DataFrame:
        return arrow_map(sets.select("class", "line"), _elements_task, "element long, class long")

    reached = connected(near, large, texts, elements, verified, percent, RARE)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "mark", "line")
    first = places.groupBy("class").agg(F.min(order).alias("first")).join(reached, "class", "left")
    lowest = first.groupBy(F.coalesce("component", "class").alias("component")).agg(F.min("first").alias("lowest"))
    return lowest.select("lowest.doc_id", "lowest.mark", "lowest.line")


def _rewrite_task() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, total, kept = [], [], []
        for text, stay in zip(batch.column(1), batch.column(2), strict=True):
            text, stay = text.as_py(), set(stay.as_py() or ())
            lines = text.split("\n") if text else []
            filled = [i for i, x in enumerate(lines) if x.strip(_BLANKS)]
            if len(stay) < len(filled):
                gone = set(filled) - stay
                text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            texts.append(text)
            total.append(len(filled))
            kept.append(len(stay))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(kept, pa.int64())], ["doc_id", "text", "n_lines", "n_kept"])

    return run


def _marked_task() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = buffers(batch.column(1))
        mark = [span_hashes(data[offs[lo] : offs[hi]], offs[lo:hi] - offs[lo], offs[lo + 1 : hi + 1] - offs[lo]) for lo, hi in slices(offs)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(mark).astype(np.int64))], ["doc_id", "text", "mark"])

    return run


def deduped_lines(docs: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """A row for each row of docs: doc_id, text without the lines that go, n_lines and n_kept (not blank).

    A null text stays null and has no lines. Rows that repeat a doc_id are documents of their own if their texts
    differ; equal rows are one document, and each shows its result. Other columns are ignored; an empty table
    gives an empty result. Texts are shuffled once, to meet the numbers of their lines that stay."""
    of = F.xxhash64("doc_id", "mark")
    per_doc = kept_lines(docs, percent, text=text, key=key, **options).groupBy(of.alias("of")).agg(F.collect_list("line").alias("stay"))
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    rows = arrow_map(rows, _marked_task, "doc_id long, text string, mark long").withColumn("of", of)
    return arrow_map(rows.join(per_doc, "of", "left").select("doc_id", "text", "stay"), _rewrite_task, "doc_id long, text string, n_lines long, n_kept long")


def line_digest(docs: DataFrame, **options) -> DataFrame:
    """deduped_lines() with the text as its number of characters and sha256 (null: of the empty text)."""
    text = F.coalesce("text", F.lit(""))
    return deduped_lines(docs, **options).select("doc_id", "n_lines", "n_kept", F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))

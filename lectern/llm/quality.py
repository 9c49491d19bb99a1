"""Quality classifier (operator 4): random Fourier features, ridge by normal equations, isotonic calibration.

A document is some statistics of its whole text. Random Fourier features approximate a Gaussian kernel over
them; each partition of the labelled rows sums its part of the normal equations, for each fold, and the
driver adds the parts (their number is bounded, and so is their size) and solves. Each fold's rows are scored by the
ridge model of the other folds, and an isotonic fit (pool adjacent violators) of these held-out scores calibrates
the model of all folds. Scoring is one narrow map over all documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored
from .textnum import Words, buffers, distinct_sorted, shingles, slices, sums_by

#: Labelled rows that a model is fitted on at most: those with the lowest hashes of their ids.
MOST_LABELS = 20_000
FEATURES = 240
FOLDS = 5
PARTS = 8
RIDGE = 1e-3
STATISTICS = ("log_words", "log_word_length", "symbols", "digits", "capitals", "bars", "exclaims", "same_again", "distinct", "repeated_shingles", "breaks", "beyond_ascii", "stops", "marked_words")

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True


def _in_rows(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return (total[at[1:]] - total[at[:-1]]).astype(np.float64)


def statistics(data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """A row of STATISTICS for each of the texts lo..hi; a text without words has zeros."""
    w = Words(data, offs, lo, hi, "spaced")
    raw = data[offs[lo] : offs[hi]]
    n = w.count.astype(np.float64)
    words, size = np.maximum(n, 1), np.maximum(np.diff(w.at).astype(np.float64), 1)
    letters = np.maximum(_in_rows(_LETTER[raw], w.at), 1)
    h = w.hashes()
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    _, _, at = distinct_sorted(h, w.row, w.rows)
    s, row = shingles(w, 5)
    _, _, parts = distinct_sorted(s, row, w.rows)
    grams = np.maximum(np.bincount(row, minlength=w.rows), 1)
    marked = _SYMBOL[w.data[w.end - 1]] if len(h) else np.zeros(0, bool)
    lengths = sums_by((w.end - w.start).astype(np.uint64), w.first).astype(np.float64)
    out = np.column_stack([
        np.log1p(n), np.log1p(lengths / words), np.sqrt(_in_rows(_SYMBOL[raw], w.at) / size), np.sqrt(_in_rows(_DIGIT[raw], w.at) / size), np.sqrt(_in_rows(_UPPER[raw], w.at) / letters),
        np.sqrt(_in_rows(raw == 0x7C, w.at) / words), np.sqrt(_in_rows(raw == 0x21, w.at) / words), np.sqrt(np.bincount(w.row[again], minlength=w.rows) / words), np.log1p(np.diff(at)) / np.log1p(words),
        np.sqrt(np.maximum(1 - np.diff(parts) / grams, 0)), np.sqrt(_in_rows(raw == 0x0A, w.at) / words), _in_rows(raw >= 0x80, w.at) / size, np.sqrt(_in_rows(raw == 0x2E, w.at) / words), np.sqrt(np.bincount(w.row[marked], minlength=w.rows) / words),
    ])
    out[n == 0] = 0
    return out


def _statistics_task(column: int, keep: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = buffers(batch.column(column))
        x = np.concatenate([statistics(data, offs, lo, hi) for lo, hi in slices(offs)])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:keep], flat], [*batch.schema.names[:keep], "x"])

    return run


@dataclass
class Kernel:
    """Standardised statistics to random Fourier features, with the statistics and 1 beside them."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray

    @classmethod
    def over(cls, mean: np.ndarray, scale: np.ndarray, features: int, seed: int = 7, width: float = 3.0) -> Kernel:
        rng = np.random.default_rng(seed)
        return cls(mean, scale, rng.normal(size=(len(mean), features)) / width, rng.uniform(0, 2 * np.pi, features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.waves + self.phase), 0.1 * z, np.ones((len(x), 1))], 1)


def _sums_task(kernel: Kernel, folds: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fold, y = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.float64)
        x = np.asarray(batch.column(2).flatten()).reshape(len(y), -1)
        z = kernel(x)
        rows = []
        for f in range(folds):
            own = fold == f
            rows.append(np.concatenate([(z[own].T @ z[own]).ravel(), z[own].T @ y[own], [own.sum()]]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(range(folds), pa.int32()), pa.array(rows, pa.binary())], ["fold", "sums"])

    return run


def pooled(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on score by pooling adjacent violators: the blocks' mean scores and values."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, sum of score, rows
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, s, 1.0])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            v2, s2, n2 = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += s2
            blocks[-1][2] += n2
    b = np.array(blocks)
    return b[:, 1] / b[:, 2], (b[:, 0] + 0.5 * b[:, 0] / b[:, 2]) / (b[:, 2] + 0.5)


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.kernel(x) @ self.weights, self.at, self.value), 0.0, 1.0)


def fitted(docs: DataFrame, labels: DataFrame, features: int = FEATURES, most: int = MOST_LABELS, text: str = "text", key: str = "doc_id", label: str = "label") -> Model:
    """A model of labels (key, label 0 or 1) on at most `most` labelled rows of docs, those with the lowest hashes of their ids (rows that
    repeat an id count each).

    Null keys and labels teach nothing. Without any labelled text every score is 0.5; if all have one label, that label's value."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.col(label).cast("double").alias("_y"))
    chosen = chosen.dropDuplicates().orderBy(F.xxhash64("_key"), "_key", "_y").limit(most)  # the bound of the broadcast
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
    rows = rows.select((F.pmod(F.xxhash64(F.lit("fold"), "_key"), F.lit(FOLDS))).cast("int").alias("fold"), "_y", "_key", F.xxhash64("_text").alias("_h"), "_text")
    x = stored(arrow_map(rows, partial(_statistics_task, 4, 4), "fold int, _y double, _key long, _h long, x array<double>").repartition(PARTS), "statistics")
    if x.count() > most:  # ids that repeat
        x = stored(x.orderBy(F.xxhash64("_key"), "_key", "_y", "_h").limit(most).repartition(PARTS), "statistics")
    x = x.select("fold", "_y", "x")
    d = len(STATISTICS)
    facts = x.agg(F.count("*"), F.avg("_y"), *[F.avg(F.col("x")[i]) for i in range(d)], *[F.stddev_pop(F.col("x")[i]) for i in range(d)]).first()
    if not facts[0] or facts[1] in (0.0, 1.0):
        flat = np.zeros(d)
        kernel = Kernel.over(flat, flat + 1, 1)
        return Model(kernel, np.zeros(d + 2), np.zeros(1), np.array([0.5 if not facts[0] else facts[1]]))
    mean, scale = np.array(facts[2 : 2 + d]), np.maximum(np.array(facts[2 + d :]), 1e-3)
    kernel = Kernel.over(mean, scale, features)
    size = features + d + 1
    parts = np.zeros((FOLDS, size * size + size + 1))
    for row in arrow_map(x, partial(_sums_task, kernel, FOLDS), "fold int, sums binary").toLocalIterator():
        parts[row[0]] += np.frombuffer(row[1])

    def solved(s: np.ndarray) -> np.ndarray:
        a = s[: size * size].reshape(size, size)
        return np.linalg.solve(a + RIDGE * max(s[-1], 1) / size * np.eye(size), s[size * size : -1])

    whole = parts.sum(0)
    by_fold = [solved(whole - p) for p in parts]
    held = [(f, y, v) for f, y, v in x.toLocalIterator()]  # at most `most` rows
    fold, y = np.array([r[0] for r in held]), np.array([r[1] for r in held])
    z = kernel(np.array([r[2] for r in held]))
    out = np.einsum("ij,ij->i", z, np.array(by_fold)[fold])
    return Model(kernel, solved(whole), *pooled(out, y))


def _score_task(model: Model) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = buffers(batch.column(1))
        s = np.concatenate([model.score(statistics(data, offs, lo, hi)) for lo, hi in slices(offs)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def scored(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of docs: doc_id, score, predicted (1 if score >= 0.5).

    Only the text is looked at; a null text is an empty one. Repeated rows are repeated, other columns ignored;
    an empty table gives an empty result."""
    return arrow_map(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), partial(_score_task, model), "doc_id long, score double, predicted int")


def split_labels(labels: DataFrame, label: str, parts: int, held: int) -> DataFrame:
    """doc_id, label of the rows that may teach: those whose crc32(doc_id as text) mod parts is not held."""
    return labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) != held).select("doc_id", F.col(label).alias("label"))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; a null id is not held out."""
    model = fitted(docs, split_labels(labels, "quality", 3, 1))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")

"""Toxicity (operator 7): a bidirectional gated recurrent network with attention pooling, in numpy.

A text is its words (runs of letters and digits, A-Z lower-cased) in overlapping windows of WINDOW words, a
half window apart, which cover it whole. A word's input has a word part (an embedding by its hash) and a
character part (embeddings of its character trigrams and five-grams: their mean, and by component their
greatest). Two gated recurrent layers read a window forwards and backwards; attention weighs their states; a
linear unit scores the sum. A text's logit comes from its strongest window; calibration is by held-out fitting
rows. All that the network knows of labels it has learnt by gradients through it.

Fitting: which window makes a text toxic is not known. The first rounds train on windows of every fitting text drawn
without regard to what is in them (up to DRAWN a text, so that no text counts by its length); what occurs in
texts of both labels cancels out. Each round after them scores all windows of the fitting texts and trains on each text's
strongest window, and on drawn ones of clean texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .quality import split_labels
from .textnum import U, Words, buffers, mix, slices

#: Labelled rows, and bytes of their texts, that a model is fitted on at most.
MOST_LABELS, MOST_BYTES = 6_000, 48 << 20
WINDOW = 32
HIDDEN = 8
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 15
WORD_WIDTH, GRAM_WIDTH = 8, 8
#: Words and grams that few fitting texts have are all the same unknown one: under these numbers, or the square root of the texts' number times these
#: shares. They are counted by hash in so many cells.
LEAST_TEXTS, LEAST_GRAM_TEXTS, CELLS = (3, 0.17), (8, 0.5), 1 << 20
#: Rounds on drawn windows, rounds in all, passes of a round; windows drawn from a text.
BLIND, ROUNDS, PASSES, DRAWN = 2, 6, 3, 12
BATCH, RATE = 256, 0.01
#: Steps of a round at least, so that a few labelled rows are gone over more often.
LEAST_STEPS = 40
#: Rate of the embeddings, whose steps are in proportion to their gradients: what few texts have moves little.
EMBED_RATE, EMBED_DECAY = 60.0, 1e-4
SLICE = 1 << 20
f32 = np.float32


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the byte trigrams and five-grams of words, with a mark before and after each; and bounds of the words."""
    size = end - start + 2
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(int(at[-1]), 1, U)
    inner = np.arange(int((size - 2).sum())) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2)
    flat[inner + np.repeat(at[:-1] + 1, size - 2)] = data[inner + np.repeat(start, size - 2)].astype(U) + U(2)
    wide = np.concatenate([np.zeros(2, U), flat, np.zeros(2, U)])
    n = len(flat)
    left = np.arange(n) - np.repeat(at[:-1], size)
    right = np.repeat(at[1:], size) - 1 - np.arange(n)
    a = np.where(left > 0, wide[1 : n + 1], U(0))
    b = np.where(right > 0, wide[3 : n + 3], U(0))
    three = mix((a << U(20)) + (flat << U(10)) + b + U(3 << 40))
    a2 = np.where(left > 1, wide[:n], U(0))
    b2 = np.where(right > 1, wide[4 : n + 4], U(0))
    five = mix((a2 << U(40)) + (a << U(30)) + (flat << U(20)) + (b << U(10)) + b2 + U(5 << 55))
    return three, five, at


class Inputs:
    """The distinct words of some texts: bucket numbers of each, and which word stands where."""

    def __init__(self, w: Words):
        h = w.hashes()
        self.hash, first, self.word = np.unique(h, return_index=True, return_inverse=True)
        three, five, self.at = _grams(w.data, w.start[first], w.end[first])
        # Cells, of which buckets are the rests: the buckets' number divides theirs.
        self.cell, self.three, self.five = ((x % U(CELLS)).astype(np.int32) for x in (self.hash, three, five))
        self.first, self.count, self.rows = w.first, w.count, w.rows


def windows(count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, sizes and rows of the windows; a text without words has one of size 0."""
    extra = np.maximum(0, -(-(count - WINDOW) // (WINDOW // 2)))
    many = extra + 1
    row = np.repeat(np.arange(len(count)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = np.maximum(np.minimum(k * (WINDOW // 2), count[row] - WINDOW), 0)
    return first[row] + start, np.minimum(count[row], WINDOW), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return f32(0.5) * np.tanh(f32(0.5) * x) + f32(0.5)


def _segment_mean(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, at[:-1], axis=0) / np.diff(at)[:, None].astype(f32)


@dataclass
class Network:
    p: dict[str, np.ndarray]
    known_words: np.ndarray
    known_grams: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fresh(cls, known_words: np.ndarray, known_grams: np.ndarray, seed: int = 11) -> Network:
        """known_words, known_grams: by cell, whether its words (grams) have embeddings of their own."""
        rng = np.random.default_rng(seed)
        width, h = WORD_WIDTH + 2 * GRAM_WIDTH, HIDDEN
        p = {"word": rng.normal(size=(WORD_BUCKETS + 1, WORD_WIDTH)) * 0.02, "gram": rng.normal(size=(GRAM_BUCKETS + 1, GRAM_WIDTH)) * 0.02, "attend": np.zeros(2 * h), "out": rng.normal(size=2 * h) * 0.3, "bias": np.zeros(1)}
        for d in "fb":
            p |= {f"w{d}": rng.normal(size=(width, 3 * h)) / np.sqrt(width), f"u{d}": rng.normal(size=(h, 3 * h)) / np.sqrt(h), f"c{d}": np.zeros(3 * h)}
        return cls({k: v.astype(f32) for k, v in p.items()}, known_words, known_grams)

    def buckets(self, x: Inputs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the embeddings of words, trigrams and five-grams; the last row is that of unknown ones."""
        word = np.where(self.known_words[x.cell], x.cell % WORD_BUCKETS, WORD_BUCKETS)
        return word, *(np.where(self.known_grams[g], g % GRAM_BUCKETS, GRAM_BUCKETS) for g in (x.three, x.five))

    def inputs(self, x: Inputs, keep: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row for each distinct word; keep: also the embeddings of its grams and which are the greatest."""
        if not len(x.hash):
            v = np.zeros((0, WORD_WIDTH + 2 * GRAM_WIDTH), f32)
            return (v, v, v) if keep else v
        word, three, five = self.buckets(x)
        g = self.p["gram"][three] + self.p["gram"][five]
        top = np.maximum.reduceat(g, x.at[:-1], axis=0)
        v = np.concatenate([self.p["word"][word], _segment_mean(g, x.at), top], 1).astype(f32)
        return (v, g, top) if keep else v

    def projected(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([v @ self.p[f"w{d}"] + self.p[f"c{d}"], np.zeros((1, 3 * HIDDEN), f32)]) for d in "fb")

    def run(self, v: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows. index: words (len(v) where there is none), mask: where there is one, both windows x WINDOW."""
        h, (n, t) = HIDDEN, index.shape
        states, memo = np.zeros((t, n, 2 * h), f32), {}
        for d, gates, steps in zip("fb", self.projected(v), (range(t), range(t - 1, -1, -1)), strict=True):
            s, u = np.zeros((n, h), f32), self.p[f"u{d}"]
            side = slice(0, h) if d == "f" else slice(h, 2 * h)
            trail = []
            for k in steps:
                a, b = gates[index[:, k]], s @ u
                zr = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
                m = mask[:, k, None]
                if keep:
                    trail.append((k, s, z, r, c, b[:, 2 * h :]))
                s = s + m * z * (c - s)
                states[k, :, side] = s
            memo[d] = trail
        score = np.where(mask.T, states @ self.p["attend"], f32(-1e9))
        score -= score.max(0)
        weight = np.exp(score) * mask.T
        weight /= np.maximum(weight.sum(0), f32(1e-9))
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return logit, {"states": states, "weight": weight, "pooled": pooled, "memo": memo} if keep else {}

    def gradients(self, x: Inputs, index: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the sum of the weighted cross-entropies of windows with labels y."""
        (v, grams, top), h, (n, t) = self.inputs(x, True), HIDDEN, index.shape
        logit, m = self.run(v, index, mask, True)
        g = ((_sigmoid(logit) - y) * weight).astype(f32)
        out = {"bias": np.array([g.sum()]), "out": m["pooled"].T @ g}
        d_pool = g[:, None] * self.p["out"]
        states, a = m["states"], m["weight"]
        d_a = np.einsum("tnh,nh->tn", states, d_pool)
        d_score = a * (d_a - (a * d_a).sum(0))
        out["attend"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = a[:, :, None] * d_pool + d_score[:, :, None] * self.p["attend"]
        d_v = np.zeros((len(v) + 1, v.shape[1]), f32)
        for d in "fb":
            u, side = self.p[f"u{d}"], slice(0, h) if d == "f" else slice(h, 2 * h)
            ds, d_u, d_gates = np.zeros((n, h), f32), np.zeros_like(u), np.zeros((t, n, 3 * h), f32)
            for k, s, z, r, c, b in reversed(m["memo"][d]):
                ds = ds + d_states[k][:, side]
                move = mask[:, k, None] * ds
                d_c = move * z * (1 - c * c)
                d_z = move * (c - s) * z * (1 - z)
                d_r = d_c * b * r * (1 - r)
                back = np.concatenate([d_z, d_r, d_c * r], 1)
                d_u += s.T @ back
                d_gates[k] = np.concatenate([d_z, d_r, d_c], 1)
                ds = ds - move * z + back @ u.T
            flat, where = d_gates.reshape(-1, 3 * h), index.T.ravel()
            own = np.stack([np.bincount(where, flat[:, j], len(v) + 1) for j in range(3 * h)], 1).astype(f32)[:-1]
            out[f"u{d}"], out[f"w{d}"], out[f"c{d}"] = d_u, v.T @ own, own.sum(0)
            d_v[:-1] += own @ self.p[f"w{d}"].T
        d_v = d_v[:-1]
        d_word, d_gram = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
        word, three, five = self.buckets(x)
        np.add.at(d_word, word, d_v[:, :WORD_WIDTH])
        size = np.diff(x.at)
        word_of = np.repeat(np.arange(len(size)), size)
        mean, best = d_v[:, WORD_WIDTH : WORD_WIDTH + GRAM_WIDTH] / size[:, None], d_v[:, WORD_WIDTH + GRAM_WIDTH :]
        d_g = mean[word_of] + best[word_of] * (grams == top[word_of]) if len(size) else np.zeros((0, GRAM_WIDTH), f32)
        for which in (three, five):
            np.add.at(d_gram, which, d_g)
        return out | {"word": d_word, "gram": d_gram}

    def logits(self, x: Inputs) -> np.ndarray:
        """The strongest window's logit for each text."""
        start, size, row = windows(x.count, x.first)
        best = np.full(x.rows, -np.inf, f32)
        if x.rows:
            np.maximum.at(best, row, self.of_windows(x, start, size))
        return best

    def of_windows(self, x: Inputs, start: np.ndarray, size: np.ndarray, step: int = 16_384) -> np.ndarray:
        v, out = self.inputs(x), np.zeros(len(start), f32)
        for lo in range(0, len(start), step):
            index, mask = _places(x, start[lo : lo + step], size[lo : lo + step], len(v))
            out[lo : lo + step] = self.run(v, index, mask)[0]
        return out

    def score(self, x: Inputs) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * self.logits(x).astype(np.float64) + b, -30, 30)))


def _places(x: Inputs, start: np.ndarray, size: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(WINDOW)
    mask = k < size[:, None]
    if not len(x.word):
        return np.full(mask.shape, none), mask
    return np.where(mask, x.word[np.minimum(start[:, None] + k, len(x.word) - 1)], none), mask


def _known(parts: list[Inputs], fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of words, and of grams, that enough of the fitting texts have. Labels are not looked at."""
    words, grams = np.zeros(CELLS, np.int32), np.zeros(CELLS, np.int32)
    for n, (x, r) in enumerate((x, r) for x in parts for r in range(x.rows)):
        if fit[n]:
            own = np.unique(x.word[x.first[r] : x.first[r + 1]])
            words[np.unique(x.cell[own])] += 1
            size = x.at[own + 1] - x.at[own]
            ends = np.cumsum(size)
            flat = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(x.at[own] - ends + size, size)
            grams[np.unique(np.concatenate([x.three[flat], x.five[flat]]))] += 1
    root = float(np.sqrt(fit.sum()))
    return words >= max(LEAST_TEXTS[0], LEAST_TEXTS[1] * root), grams >= max(LEAST_GRAM_TEXTS[0], LEAST_GRAM_TEXTS[1] * root)


def _chosen(net: Network, x: Inputs, spans: tuple[np.ndarray, ...], rows: np.ndarray, y: np.ndarray, blind: bool, rng: np.random.Generator) -> list[tuple[int, int, float, float]]:
    """start, size, label and weight of the windows that a round trains on, of the rows of x."""
    start, size, row = spans
    out = []
    z = None if blind else net.of_windows(x, start, size)
    bounds = np.searchsorted(row, np.arange(x.rows + 1))
    for r in rows.tolist():
        a, b = int(bounds[r]), int(bounds[r + 1])
        if z is not None:
            top = a + int(np.argmax(z[a:b]))
            out.append((start[top], size[top], y[r], 1.0))
        if z is None or not y[r]:
            n = min(DRAWN if z is None else 1, b - a)
            some = a + rng.choice(b - a, n, replace=False)
            out += [(start[k], size[k], y[r], 1.0 / n) for k in some.tolist()]
    return out


def trained(texts: list[str], labels: list[int]) -> Network:
    """A network fitted on texts; every fourth is kept for calibration."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        net = Network.fresh(np.zeros(CELLS, bool), np.zeros(CELLS, bool))
        net.p["out"] *= 0
        p = 0.5 if not len(y) else float(np.clip(y[0], 0.01, 0.99))
        net.calibration = (0.0, float(np.log(p / (1 - p))))
        return net
    data, offs = buffers(pa.array(texts, pa.string()))
    parts = [Inputs(Words(data, offs, lo, hi, "alnum")) for lo, hi in slices(offs, SLICE)]
    fit = np.arange(len(y)) % 4 != 3
    net = Network.fresh(*_known(parts, fit))
    rng = np.random.default_rng(5)
    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k not in ("word", "gram")}
    step = 0
    begin = np.cumsum([0] + [x.rows for x in parts])
    spans = [windows(x.count, x.first) for x in parts]
    for turn in range(ROUNDS):
        chosen = []
        for i, x in enumerate(parts):
            own = y[begin[i] : begin[i + 1]]
            chosen.append(_chosen(net, x, spans[i], np.flatnonzero(fit[begin[i] : begin[i + 1]]), own, turn < BLIND, rng))
        toxic = sum(w for c in chosen for _, _, v, w in c if v)
        clean = sum(w for c in chosen for _, _, v, w in c if not v)
        rows = sum(map(len, chosen))
        steps = sum(-(-len(c) // BATCH) for c in chosen)
        for _ in range(max(PASSES, -(-LEAST_STEPS // steps))):
            batches = []
            for i, own in enumerate(chosen):
                rng.shuffle(own)
                batches += [(i, own[a : a + BATCH]) for a in range(0, len(own), BATCH)]
            rng.shuffle(batches)
            for i, own in batches:
                x = parts[i]
                index, mask = _places(x, np.array([c[0] for c in own]), np.array([c[1] for c in own]), len(x.hash))
                used, back = np.unique(index, return_inverse=True)
                used = used[used < len(x.hash)]
                back = back.reshape(index.shape)
                sub = object.__new__(Inputs)
                sizes = np.diff(x.at)[used]
                flat = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(x.at[used], sizes)
                sub.hash, sub.cell, sub.three, sub.five, sub.at = x.hash[used], x.cell[used], x.three[flat], x.five[flat], np.concatenate([[0], np.cumsum(sizes)])
                label = np.array([c[2] for c in own])
                weight = np.array([c[3] for c in own]) * np.where(label > 0, 0.5 / toxic, 0.5 / clean)
                grads = net.gradients(sub, back, mask, label, weight * rows / len(own))
                step += 1
                rate = min(1, step / 20) * (0.5 ** max(0, turn - BLIND))
                for k, g in grads.items():
                    if k in ("word", "gram"):
                        net.p[k] -= (rate * (EMBED_RATE * g + EMBED_DECAY * net.p[k])).astype(f32)
                        continue
                    m, s = adam[k]
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    net.p[k] -= (RATE * rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(f32)
    z = np.concatenate([net.logits(x) for x in parts]).astype(np.float64)
    a, b = 1.0, 0.0
    kept = ~fit
    if not 0 < y[kept].sum() < kept.sum():
        kept = fit
    zz, yy = z[kept], y[kept]
    for _ in range(50):  # Newton steps of a logistic regression with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * zz + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - yy) * zz).sum() + 0.05 * a, (p - yy).sum()])
        hess = np.array([[(w * zz * zz).sum() + 0.05, (w * zz).sum()], [(w * zz).sum(), w.sum()]])
        d = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(d[0], -1, 1)), b - float(np.clip(d[1], -1, 1))
    net.calibration = (max(a, 0.0), b)
    return net


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS, most_bytes: int = MOST_BYTES, text: str = "text", key: str = "doc_id", label: str = "label") -> Network:
    """A network of at most `most` labelled rows of docs, with most_bytes of whole texts (UTF-8) at most, in the order of a hash of their ids.

    A text that does not fit into what is left of most_bytes is passed over. Null keys and labels teach nothing; a null text is an empty
    one; equal rows count once. With no labels every score is 0.5."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.col(label).cast("int").alias("_y"))
    chosen = chosen.dropDuplicates().orderBy(F.xxhash64("_key"), "_key", "_y").limit(most)  # the bound of the broadcast
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_key").withColumn("_h", F.xxhash64("_text"))
    order = (F.xxhash64("_key"), "_key", "_y", "_h")
    held = rows.select("_key", "_y", "_h", F.octet_length("_text").alias("_n")).distinct().orderBy(*order).limit(most).collect()
    taken, left = [], most_bytes
    for r in held:
        if r._n <= left:
            left -= r._n
            taken.append((r._key, r._y, r._h))
    if not taken:
        return trained([], [])
    few = F.broadcast(docs.sparkSession.createDataFrame(taken, "_key long, _y int, _h long"))
    texts = rows.join(few, ["_key", "_y", "_h"]).dropDuplicates(["_key", "_y", "_h"]).orderBy(*order).select("_text", "_y").collect()
    return trained([r._text for r in texts], [r._y for r in texts])


def _score_task(broadcast) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    net = broadcast.value

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = buffers(batch.column(1))
        s = np.concatenate([net.score(Inputs(Words(data, offs, lo, hi, "alnum"))) for lo, hi in slices(offs, SLICE)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def scored(docs: DataFrame, net: Network, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of docs: doc_id, score, predicted (1 if score >= 0.5).

    Only the text is looked at, all of it; a null text is an empty one. Repeated rows are repeated, other
    columns ignored; an empty table gives an empty result. The network, whose size is fixed, is broadcast."""
    broadcast = docs.sparkSession.sparkContext.broadcast(net)
    return arrow_map(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), partial(_score_task, broadcast), "doc_id long, score double, predicted int")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; a null id is not held out."""
    net = fitted(docs, split_labels(labels, "toxic", 5, 0))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return scored(docs, net).select("doc_id", held.alias("held_out"), "score", "predicted")

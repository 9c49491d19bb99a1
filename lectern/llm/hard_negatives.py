"""Hard-negative mining (operator 11) over one-dimensional distance keys.

Inner products become distances: every row gets one more component, the root of M^2 - |x|^2 (M: the largest norm), so that all rows lie
on one sphere and an anchor (with 0 there) is at the squared distance |q|^2 + M^2 - 2 * score from each. Rows are stored sorted by
(nearest pivot, distance to it) in blocks of about BLOCK_ROWS; a block is a contiguous piece of that order, so a pivot with many
rows has many blocks. In a block the key is pivot * C + distance, and an anchor reads key intervals around its own distances to the
pivots, which grow until no row outside them can be nearer than the kth found (the triangle inequality). A search may be for an
annulus: rows no nearer than an upper limit of the score says, which leaves out the keys of rows that lie wholly inside.

An anchor first visits its own block, then, with the kth score found there, only blocks whose keys can still hold a better row."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, kept, scratch, stored

BLOCK_ROWS = 16_384
#: Anchors that meet a block in one task.
ANCHOR_ROWS = 8_192
PIVOTS = 48
#: Rows from which pivots are chosen, those with the lowest hashes of their numbers; pivots bear on speed only.
PIVOT_SAMPLE = 4_096
#: The first interval's reach is that of about so many rows; it doubles from step to step.
FIRST_ROWS = 256
#: Scores below this are exact in doubles, whatever the order of their sums.
EXACT = 2.0**53
FAR = 2**62


def labelled(table: DataFrame, scale: int, relabel: int, labels: int, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, v: floor(scale * x) of each component. Rows with a null id, label or vector, or a component that is null or not finite, are left out;
    where relabel divides the id, the label is the next of labels."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    moved = F.when(F.col(key) % relabel == 0, (F.col(label) + 1) % labels).otherwise(F.col(label))
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    return table.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(key).cast("long").alias("vec_id"), moved.cast("long").alias("label"), v.alias("v")
    )


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column whose lists have width elements each."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass(frozen=True)
class Sphere:
    """What all tasks know: the width of vectors, the squared radius and the pivots (with the extra component)."""

    width: int
    square: float
    pivots: np.ndarray

    def distances(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Of each row (with its extra component) to each pivot."""
        p = self.pivots
        square = (x * x).sum(1)[:, None] + (extra * extra)[:, None] + (p * p).sum(1)[None] - 2 * (x @ p[:, :-1].T + extra[:, None] * p[None, :, -1])
        return np.sqrt(np.maximum(square, 0))

    def extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - (x * x).sum(1), 0))

    def best_score(self, norm: float, distance: np.ndarray) -> np.ndarray:
        """The highest whole score that a row at least so far away can have; the slack covers what rounding does to distances."""
        return np.floor((norm + self.square - distance * distance) / 2 + 1e-6 * (norm + self.square) + 1e-3)

    def reach(self, norm: float, score: float) -> float:
        """The distance within which all rows of at least this score lie."""
        return math.sqrt(max(0.0, norm + self.square - 2 * score + 2e-6 * (norm + self.square) + 2e-3))


def chosen_pivots(x: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """Of the rows x: the means of n clusters, begun from rows far from each other."""
    first = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(first) < min(n, len(x)) and near.max() > 0:
        first.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[first[-1]]) ** 2).sum(1))
    p = x[first]
    for _ in range(rounds):
        own = ((p * p).sum(1)[None] - 2 * x @ p.T).argmin(1)
        p = np.stack([x[own == i].mean(0) if (own == i).any() else p[i] for i in range(len(p))])
    return p


class Block:
    """Rows sorted by key = pivot * c + distance."""

    def __init__(self, sphere: Sphere, rows: pa.Table):
        pivot, far = rows["pivot"].to_numpy(), rows["far"].to_numpy()
        self.c = 4 * math.sqrt(sphere.square) + 1 + (float(far.max()) if len(far) else 0)
        order = np.lexsort((rows["row"].to_numpy(), far, pivot))
        self.sphere, self.pivots = sphere, np.unique(pivot)
        self.key = (pivot * self.c + far)[order]
        self.v = matrix(rows["v"], sphere.width).astype(np.float64)[order]
        self.id, self.row, self.label = (rows[c].to_numpy()[order] for c in ("vec_id", "row", "label"))
        self.ends = np.searchsorted(self.key, np.stack([self.pivots * self.c, (self.pivots + 1) * self.c - 0.5]))
        self.reads = 0

    def search(self, q: np.ndarray, own: int, label: int, same: bool, limits: list[tuple[int, int, int]], k: int) -> list[np.ndarray]:
        """Rows (their places here) for each limit (low, high, kth): the k best of low <= score <= high, of the anchor's label or of any other.

        kth: a score that k rows elsewhere reach, which frees from reading what can only be lower."""
        sphere, norm = self.sphere, float(q @ q)
        to = sphere.distances(q[None], np.zeros(1))[0][self.pivots]
        inner = min(self._inside(norm, high) for _, high, _ in limits)
        outer = max(sphere.reach(norm, max(low, kth)) for low, _, kth in limits) if min(max(low, kth) for low, _, kth in limits) > -FAR else math.inf
        low_key = np.maximum(inner - to, 0)
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        found = [places] * len(limits)
        a = b = np.clip(np.searchsorted(self.key, self.pivots * self.c + np.maximum(to, low_key)), self.ends[0], self.ends[1])
        r = self._first_reach(to, low_key, a)
        while True:
            r = min(r, outer)
            left = np.clip(np.searchsorted(self.key, self.pivots * self.c + np.maximum(to - r, low_key)), self.ends[0], a)
            right = np.clip(np.searchsorted(self.key, self.pivots * self.c + to + r, "right"), b, self.ends[1])
            new = np.concatenate([*(np.arange(i, j) for i, j in zip(left, a, strict=True) if i < j), *(np.arange(i, j) for i, j in zip(b, right, strict=True) if i < j), np.zeros(0, np.int64)])
            a, b = left, right
            new = new[((self.label[new] == label) == same) & (self.id[new] != own)]
            self.reads += len(new)
            places, scores = np.concatenate([places, new]), np.concatenate([scores, self.v[new] @ q])
            rest = -math.inf if r >= outer or ((a <= np.searchsorted(self.key, self.pivots * self.c + low_key)) & (b >= self.ends[1])).all() else float(sphere.best_score(norm, np.array(r)))
            done = rest == -math.inf
            if len(new) or done:
                keep = []
                for i, (low, high, kth) in enumerate(limits):
                    ok = np.flatnonzero((scores >= low) & (scores <= high) & (scores >= kth))
                    best = ok[np.lexsort((self.row[places[ok]], self.id[places[ok]], -scores[ok]))[:k]]
                    found[i] = places[best]
                    keep.append(best)
                done = done or all((len(x) == k and scores[x[-1]] > rest) or max(low, kth) > rest for x, (low, _, kth) in zip(keep, limits, strict=True))
                kept_ = np.unique(np.concatenate(keep))
                places, scores = places[kept_], scores[kept_]
            if done:
                return found
            r *= 2

    def _inside(self, norm: float, high: int) -> float:
        """The distance that a row of at most this score has at least."""
        return 0.0 if high >= FAR else math.sqrt(max(0.0, norm + self.sphere.square - 2 * high - 2e-6 * (norm + self.sphere.square) - 2e-3))

    def _first_reach(self, to: np.ndarray, low: np.ndarray, at: np.ndarray) -> float:
        """A reach within which each pivot has some rows, as the rows next to the anchor's own keys say."""
        if not len(self.key):
            return 1.0
        step = max(1, FIRST_ROWS // len(self.pivots))
        ends = np.stack([np.maximum(at - step, self.ends[0]), np.minimum(at + step, self.ends[1] - 1)])
        gap = np.abs(self.key[ends] - self.pivots * self.c - to).min(0)
        return max(float(gap.min()), float(np.maximum(low - to, 0).min()), 1e-3 * self.c)


FOUND = "anchor long, anchor_id long, slot int, row long, vec_id long, score long"


def _meet(sphere: Sphere, same: bool, k: int, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """One block and anchors that visit it."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    got: list[tuple] = []
    if anchors.num_rows and rows.num_rows:
        block = Block(sphere, rows)
        own = (anchors[c].to_pylist() for c in ("anchor", "anchor_id", "label", "limits"))
        for q, anchor, anchor_id, label, limits in zip(matrix(anchors["v"], sphere.width).astype(np.float64), *own, strict=True):
            found = block.search(q, anchor_id, label, same, [(x["low"], x["high"], x["kth"]) for x in limits], k)
            for x, at in zip(limits, found, strict=True):
                n = len(at)
                got.append((np.full(n, anchor), np.full(n, anchor_id), np.full(n, x["slot"]), block.row[at], block.id[at], block.v[at] @ q))
    if not got:
        return pa.table({n: pa.array([], pa.int32() if n == "slot" else pa.int64()) for n in names})
    columns = [np.concatenate(c) for c in zip(*got, strict=True)]
    return pa.table({n: pa.array(c.astype(np.int32 if n == "slot" else np.int64)) for n, c in zip(names, columns, strict=True)})


class Index:
    """Rows stored by (pivot, distance) in blocks, and the bounds of each block: one row for each block and pivot in it."""

    def __init__(self, rows: DataFrame, is_anchor: F.Column, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS, pivots: int = PIVOTS):
        """rows: vec_id, label, v (integers). Shorter vectors count as filled up with zeros."""
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, width, top, size = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(square), F.max(F.array_max(F.transform("v", F.abs)))).first()
        self.width = width or 1
        if (size or 0) ** 2 * self.width >= EXACT:
            raise OverflowError("scores are not exact in doubles")
        fill = F.expr(f"concat(v, array_repeat(0L, {self.width} - size(v)))")
        rows = rows.withColumn("v", fill)
        some = rows.orderBy(F.xxhash64("row"), "row").limit(PIVOT_SAMPLE).select("v").toArrow()
        x = matrix(some["v"], self.width).astype(np.float64) if n else np.zeros((1, self.width))
        self.sphere = Sphere(self.width, top or 0.0, np.zeros((0, self.width + 1)))
        self.sphere = Sphere(self.width, top or 0.0, chosen_pivots(np.column_stack([x, self.sphere.extra(x)]), pivots))
        keyed = arrow_map(rows, partial(_keys, self.sphere), "vec_id long, label long, v array<long>, row long, pivot int, far double")
        blocks = max(1, math.ceil(n / block_rows))
        self.rows = stored(keyed.repartitionByRange(blocks, "pivot", "far", "row").sortWithinPartitions("pivot", "far", "row").withColumn("block", F.spark_partition_id()), "blocks")
        # One row for each block and each pivot that it has rows of: as many as blocks and pivots together, at most.
        self.bounds = self.rows.groupBy("block", "pivot").agg(F.min("far").alias("low"), F.max("far").alias("high")).orderBy("block", "pivot").toArrow()
        self.parts = max(1, math.ceil(self.rows.where(is_anchor).count() / anchor_rows))

    def visit(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """FOUND for anchors: anchor, anchor_id, label, v, limits, and the block that each visits."""
        asked = stored(anchors.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(self.parts)).cast("int")), "asked")
        rows = self.rows.join(asked.select("block", F.col("part").alias("part")).distinct(), "block")
        return stored(asked.groupBy("block", "part").cogroup(rows.groupBy("block", "part")).applyInArrow(partial(_meet_groups, self.sphere, same, k), FOUND), "found")

    def best(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """For each anchor and limit (slot) the k best rows of the anchor's label, or of any other: FOUND and rank (from 1).

        anchors: anchor, anchor_id, label, v, block (its own), limits: array<struct<slot int, low long, high long, kth long>>."""
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
        near = self.visit(anchors, same, k)
        kth = near.groupBy("anchor", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
        by_anchor = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kths"))
        told = F.transform("limits", lambda x: x.withField("kth", F.greatest(x.kth, F.coalesce(F.try_element_at("kths", x.slot), F.lit(-FAR)))))
        informed = anchors.join(by_anchor, "anchor", "left").withColumn("limits", told).drop("kths")
        schema = "anchor long, anchor_id long, label long, v array<long>, limits array<struct<slot: int, low: long, high: long, kth: long>>, block int"
        rest = arrow_map(informed.select("anchor", "anchor_id", "label", "v", "limits", "block"), partial(_elsewhere, self.sphere, self.bounds), schema.replace("block int", "blocks array<int>"))
        far = self.visit(rest.withColumn("block", F.explode("blocks")).drop("blocks"), same, k)
        return near.unionAll(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _meet_groups(sphere: Sphere, same: bool, k: int, left: pa.Table, right: pa.Table) -> pa.Table:
    return _meet(sphere, same, k, left, right)


def _keys(sphere: Sphere):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = matrix(batch.column("v"), sphere.width).astype(np.float64)
        far = sphere.distances(x, sphere.extra(x))
        pivot = far.argmin(1)
        columns = [batch.column(c) for c in ("vec_id", "label", "v", "row")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(far)), pivot])], ["vec_id", "label", "v", "row", "pivot", "far"])

    return run


def _elsewhere(sphere: Sphere, bounds: pa.Table):
    """Of each anchor: the other blocks of which a row may be among its best, by their keys."""
    block, pivot, low, high = (bounds[c].to_numpy() for c in ("block", "pivot", "low", "high"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = matrix(batch.column("v"), sphere.width).astype(np.float64)
        to = sphere.distances(x, np.zeros(len(x)))
        blocks = []
        for i, (q, limits, own) in enumerate(zip(x, batch.column("limits").to_pylist(), batch.column("block").to_pylist(), strict=True)):
            t, norm = to[i][pivot], float(q @ q)
            most = sphere.best_score(norm, np.maximum(np.maximum(t - high, low - t), 0))
            least = (norm + sphere.square - (t + high) ** 2) / 2 - 1e-6 * (norm + sphere.square) - 1e-3
            open_ = np.zeros(len(block), bool)
            for y in limits:
                open_ |= (most >= max(y["low"], y["kth"])) & (least <= y["high"])
            blocks.append(np.unique(block[open_ & (block != own)]).tolist())
        columns = [batch.column(c) for c in ("anchor", "anchor_id", "label", "v", "limits")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(blocks, pa.list_(pa.int32()))], ["anchor", "anchor_id", "label", "v", "limits", "blocks"])

    return run


def _limit(slot: object, low: object, high: object) -> F.Column:
    return F.struct(F.lit(slot).cast("int").alias("slot"), low.alias("low"), high.alias("high"), F.lit(-FAR).alias("kth"))


def hard_negatives(rows: DataFrame, is_anchor: F.Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, **options) -> DataFrame:
    """For each anchor its first rows of the same label (positives), and for each of these the first rows of other labels
    whose score is between least and most percent of the positive's: anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.

    rows: vec_id, label, v (integers). First is by score, ties by smaller vec_id. Rows with an anchor's id are no rows for
    it; rows that repeat an id are rows of their own, as anchors too. An anchor without positives, and a positive without
    negatives, give no row; so does an empty table."""
    with scratch():
        index = Index(rows, is_anchor, **options)
        anchors = index.rows.where(is_anchor).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v", "block")
        every = F.array(_limit(0, F.lit(-FAR), F.lit(FAR)))
        found = stored(index.best(anchors.withColumn("limits", every), True, positives).select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        low, high = F.ceil(F.col("positive_score") * least / F.lit(100)), F.floor(F.col("positive_score") * most / F.lit(100))
        span = found.withColumns({"low": low, "high": high}).where("low <= high")
        limits = span.groupBy("anchor").agg(F.collect_list(F.struct(F.col("rank").alias("slot"), "low", "high", F.lit(-FAR).alias("kth"))).alias("limits"))
        mined = index.best(anchors.join(limits, "anchor"), False, negatives)
        mined = mined.withColumnRenamed("score", "negative_score").withColumnRenamed("vec_id", "negative_id").withColumnRenamed("rank", "place")
        both = mined.join(found.withColumnRenamed("rank", "slot"), ["anchor", "slot"])
        return kept(stored(both.select("anchor_id", "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", "negative_score"), "mined"))


def negatives_digest(table: DataFrame, every: int = 100, relabel: int = 7, labels: int = 10, scale: int = 256, **options) -> DataFrame:
    """hard_negatives() of the rows whose vec_id is divisible by every, where labels of ids divisible by relabel are moved on by one."""
    return hard_negatives(labelled(table, scale, relabel, labels), F.col("vec_id") % every == 0, **options)

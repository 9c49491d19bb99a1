"""Exact top-k search (operator 1): Fagin's threshold algorithm over sorted lists, one for each dimension.

Vectors are dealt by a hash of their row number into blocks of about BLOCK_ROWS. In a block every dimension has a list
of the rows in order of its component. A query reads all lists in step (from the top where its own
component is positive, from the bottom where negative), scores each row when it is first seen, and stops
when the kth best score is above the threshold: the score of a row that had, in every dimension, the value last
read there. Depths double from step to step so that numpy reads many entries at once; once a step
would score most of what is left, the rest of the block is scored in one product. Queries are dealt into groups in the same
way, and each pair of a query group and a block is one task's work; the best k of all blocks meet in a
window by query."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK_ROWS = 16_384
QUERY_ROWS = 16_384
FIRST_DEPTH = 8
#: Scores below this are exact in doubles, whatever the order of their sums.
EXACT = 2.0**53


class Block:
    """Vectors with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T.copy()  # of each dimension, ascending
        self.values = np.take_along_axis(self.vectors, self.lists.T, 0).T.copy()
        self.reads = 0

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those with the query's own id; ties to smaller ids."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        q = query[used]
        up = q > 0
        seen = np.zeros(n, bool)
        seen[np.searchsorted(self.ids, own, "left") : np.searchsorted(self.ids, own, "right")] = True
        rows, scores = np.zeros(0, np.int64), np.zeros(0, query.dtype)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            to = min(n, depth + step)
            if len(q) and step * len(used) < n:
                top = self.lists[used[up], n - to : n - depth]
                low = self.lists[used[~up], depth:to]
                fresh = np.zeros(n, bool)
                fresh[top] = True
                fresh[low] = True
                new = np.flatnonzero(fresh & ~seen)
            else:
                to = n  # nearly all that is left would be read in this step
                new = np.flatnonzero(~seen)
            self.reads += len(new)
            seen[new] = True
            s = self.vectors[new] @ query if len(new) < n // 2 else (self.vectors @ query)[new]
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, s])
            if len(rows) > k:
                keep = np.lexsort((rows, -scores))[:k]  # rows are in order of id
                rows, scores = rows[keep], scores[keep]
            if to < n and len(rows) >= k:
                last = np.where(up, self.values[used, n - to], self.values[used, to - 1])
                if scores[k - 1] > last @ q:
                    break
            depth, step = to, step * 2
        keep = np.lexsort((rows, -scores))[:k]
        return self.ids[rows[keep]], scores[keep]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _search(k: int, key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    width = max([1, *map(len, queries.v), *map(len, rows.v)])
    q, v = _matrix(queries.v, width), _matrix(rows.v, width)
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * width < EXACT:
        q, v = q.astype(np.float64), v.astype(np.float64)
    elif float(np.abs(q).max()) * float(np.abs(v).max()) * width >= 2.0**63:
        raise OverflowError("scores do not fit a long")
    block = Block(rows.vec_id.to_numpy(), v)
    ids = queries.vec_id.to_numpy()
    found = [block.best(x, i, k) for i, x in zip(ids.tolist(), q, strict=True)]
    return pd.DataFrame({"query_id": np.repeat(ids, [len(x[0]) for x in found]), "vec_id": np.concatenate([x[0] for x in found]) if found else ids[:0], "score": np.concatenate([x[1] for x in found]).astype(np.int64) if found else ids[:0]})


def quantised(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, in doubles. Vectors that are null or hold a null or non-finite component are left out."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(F.col(vector).isNotNull() & finite & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def top_k(vectors: DataFrame, is_query: Callable[[], object], k: int = 5, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best rows for each query by inner product: query_id, rank (from 1), vec_id, score.

    vectors: vec_id, v (integers). Rows that repeat an id are rows of their own, as candidates and as queries (whose best rows meet under the
    id); a query's own rows are those with its id, and no candidates. Missing components of shorter vectors count as 0.
    Fewer candidates than k: all of them; none: no row. An empty table gives an empty result."""
    # Rows are dealt by their numbers, not by ids, which may repeat; stored, for a task that is run again must see the same numbers.
    vectors = stored(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = vectors.count()
    queries = vectors.where(is_query)
    m = queries.count()
    blocks, groups = max(1, math.ceil(n / block_rows)), max(1, math.ceil(m / query_rows))
    dealt = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = vectors.withColumn("block", dealt(blocks)).withColumn("part", every(groups))
    asked = queries.withColumn("part", dealt(groups)).withColumn("block", every(blocks))
    work = partial(_search, k)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return work(key, left, right)

    found = asked.groupBy("block", "part").cogroup(rows.groupBy("block", "part")).applyInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_digest(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256, **options) -> DataFrame:
    """top_k() of the rows whose vec_id is divisible by every, among all others.

    Rows with a null id take no part."""
    return top_k(quantised(table, scale), F.col("vec_id") % every == 0, k, **options)

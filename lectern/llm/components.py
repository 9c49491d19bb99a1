"""Distributed union-find: connected components of a table of links.

Each task joins its own share of the links first (at most LOCAL_LINKS of them) and leaves a star for each of its
components; what the shares have in common is joined by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: Links of a task's share; they are held in memory, 16 bytes each.
LOCAL_LINKS = 1_000_000


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links and the smallest node that each reaches: hooking to smaller roots and pointer jumping."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[x], root[y]
        if (a == b).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
    if parts:
        nodes, roots = union_find(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        other = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(roots[other])], ["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node around it."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. edges: a > b."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))


def components(links: DataFrame, a: str = "a", b: str = "b", local_links: int = LOCAL_LINKS) -> DataFrame:
    """A row for each node of links: node, component (the smallest node that it reaches).

    Links are pairs of longs in any order, repeats and loops allowed; links with a null take no part. Each
    round ends in a table in the shared folder, so a lost executor never costs more than a round; the
    driver sees some numbers a round. The rounds, which end when links stay as they are, grow with the logarithm of the longest chain."""
    x, y = F.col(a), F.col(b)
    given = stored(links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(x.cast("long").alias("a"), y.cast("long").alias("b")), "links")
    shares = -(-given.count() // local_links) or 1
    edges = stored(given.repartition(shares).mapInArrow(_share, "a long, b long"), "links")
    dropped(given)
    seen = None
    while shares > 1:
        new = stored(_small_star(_large_star(edges.distinct()).distinct()).where("a != b").distinct(), "links")
        dropped(edges)
        edges = new
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select("b", "b").distinct().toDF("node", "component"))

"""Mixing sources to target weights (operator 5): whole copies, then Pareto order sampling.

A source of S words and target T takes floor(T / S) copies of each of its documents for certain. The rest
is a sample with inclusion probability p = T / S - floor(T / S), other for each source: documents rank by
random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the lowest ranks are taken up to the
source's open words, where the sample's fixed size is in words: it ends at the document that brings it nearest.

The place where it ends is found without sorting a source: a histogram of ranks (BINS for each source,
summed before the shuffle) says in which bin it lies, and only that bin's documents are sorted. u is a
hash of doc_id, so reruns agree."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, stored
from .textnum import Words, buffers, slices, sums_by, mix

BINS = 4096
SEED = "mix-1"
#: Sources that a broadcast of one row each may hold.
MOST_SOURCES = 100_000


def _marks(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text and a hash of its words and their places."""
    data, offs = buffers(column)
    size, mark = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in slices(offs):
        w = Words(data, offs, lo, hi, "spaced", lower=False)
        size.append(w.count.astype(np.int64))
        mark.append(sums_by(mix(w.hashes() + (w.start - w.at[w.row]).astype(np.uint64)), w.first).astype(np.int64))
    return np.concatenate(size), np.concatenate(mark)


def _sizes_task() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, _marks(batch.column(2)))], ["doc_id", "source", "size", "mark"])

    return run


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, target: share * all words by weight, none above most * its own words.

    Sources in order of code points, null last, get the weights in turn. What a source cannot take goes to
    the others by weight: sorted by words over weight, those that are full are a prefix, and sums over that
    prefix give the level of the rest. One row for each source in one task; rows spill."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumns({"words": F.sum("source_size").over(every) * share, "all_weight": F.sum("weight").over(every), "used": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    s = s.withColumn("level", (F.col("words") - F.col("used")) / (F.col("all_weight") - F.col("gone")))
    s = s.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    s = s.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def _by_source(rows: DataFrame, few: DataFrame, small: bool) -> DataFrame:
    few = few.withColumnRenamed("source", "of")
    return rows.join(F.broadcast(few) if small else few, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """A row for each row of docs: doc_id, source, mark, size, source_size, target, copies, taken.

    size: words (runs of other than ASCII white space) of the text, 0 for null. Copies are whole, so no document
    takes more than ceil(most) times its size. A null source is a source, last in order. Null or repeated ids
    are documents of their own (a null id draws its number by the text); among equal ids the order is by size, then by mark (a hash of the text). A source without
    words has target 0 and takes none. Columns besides those named are ignored; an empty table gives none."""
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[source].cast("string").alias("source"), docs[text].alias("text"))
    sizes = stored(arrow_map(rows, _sizes_task, "doc_id long, source string, size long, mark long"), "sizes")
    goal = stored(targets(sizes, weights, share, most), "targets")
    small = goal.count() <= MOST_SOURCES
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("open", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = goal.withColumn("p", F.when(F.col("source_size") > 0, F.col("open") / F.col("source_size")).otherwise(0.0))
    digits = F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("mark").cast("string")))).cast("binary")), 1, 12)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))
    q = u / (1 - u) * (1 - F.col("p")) / F.col("p")
    rows = _by_source(sizes, goal, small).withColumn("q", F.when(F.col("p") > 0, q).otherwise(F.lit(float("inf"))))
    rows = rows.withColumn("bin", F.when(F.col("p") > 0, F.least(F.lit(BINS - 1), F.floor(F.col("q") / (1 + F.col("q")) * BINS))).otherwise(BINS).cast("int"))
    bins = rows.where(f"bin < {BINS}").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("open").alias("open"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    ends = stored(bins.where("before < open and before + words >= open").groupBy("source").agg(F.min("bin").alias("end"), F.min_by("before", "bin").alias("before")), "ends")
    few = ends.withColumnRenamed("source", "of")
    rows = rows.join(F.broadcast(few) if small else few, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    # A source all of whose words are open, up to rounding, has no end bin: all of it is below.
    end = F.coalesce(F.col("end"), F.lit(BINS + 1))
    sure = rows.where(F.col("bin") != end).withColumn("extra", (F.col("bin") < end).cast("int"))
    run = Window.partitionBy("source").orderBy("q", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where((F.col("bin") == end) & F.col("end").isNotNull()).withColumn("sum", F.sum("size").over(run) + F.col("before"))
    below, over = F.col("open") - (F.col("sum") - F.col("size")), F.col("sum") - F.col("open")
    edge = edge.withColumn("extra", ((over <= 0) | ((below > 0) & (over < below))).cast("int")).drop("sum")
    out = sure.unionByName(edge.select(*sure.columns))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("p") > 0, F.col("extra")).otherwise(0)).otherwise(0)
    out = out.withColumn("copies", copies.cast("int"))
    return out.select("doc_id", "source", "mark", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    return mix_plan(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, all their columns, each as often as the plan takes it.

    Rows meet their plan by doc_id, source and mark; equal ones share their copies, so the total stands. The texts
    are shuffled once, by a hash of these, which both the numbering of equal rows and the join use."""
    text, key, source = options.get("text", "text"), options.get("key", "doc_id"), options.get("source", "source")
    of = F.xxhash64("doc_id", "source", "mark")
    plan = mix_plan(docs, **options).groupBy(of.alias("_lectern_of")).agg(F.sum("copies").alias("_lectern_copies"), F.count(F.lit(1)).alias("_lectern_n")).where("_lectern_copies > 0")
    rows = _marked(docs, text, key, source).withColumn("_lectern_i", F.row_number().over(Window.partitionBy("_lectern_of").orderBy("_lectern_of")))
    each = F.floor(F.col("_lectern_copies") / F.col("_lectern_n")) + (F.col("_lectern_i") <= F.col("_lectern_copies") % F.col("_lectern_n")).cast("int")
    return rows.join(plan, "_lectern_of").withColumn("_lectern_each", each).where("_lectern_each > 0").withColumn("_lectern_copy", F.explode(F.sequence(F.lit(1), F.col("_lectern_each").cast("int")))).select(*docs.columns)


def _marked(docs: DataFrame, text: str, key: str, source: str) -> DataFrame:
    """docs with _lectern_of, a hash of doc_id, source and mark as mix_plan() has them."""
    at = docs.columns.index(text)

    def task() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_marks(batch.column(at))[1])], [*batch.schema.names, "_lectern_mark"])

        return run

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, task, f"{schema}, _lectern_mark long").withColumn("_lectern_of", F.xxhash64(F.col(key).cast("long"), F.col(source).cast("string"), F.col("_lectern_mark"))).drop("_lectern_mark")

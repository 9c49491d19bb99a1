"""Rows of a table that an operator keeps, with all their columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_map

#: Stands for a null id where ids are compared; null ids are one id there.
NO_ID = -(1 << 63)


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def kept_rows(docs: DataFrame, task: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], column: str, good: Callable[[pa.Array], pa.Array], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of docs for which good() holds of the column that the operator's task gives; one narrow map."""
    at, of = docs.columns.index(text), docs.columns.index(key)

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        g = task()

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            got = pa.Table.from_batches(list(g(pa.RecordBatch.from_arrays([batch.column(of), batch.column(at)], ["doc_id", "text"])))).column(column).combine_chunks()
            yield batch.filter(good(got))

        return run

    return arrow_map(docs, make, schema_of(docs))


def positive(x: pa.Array) -> pa.Array:
    return pc.greater(x, 0)


def none(x: pa.Array) -> pa.Array:
    return pc.equal(x, 0)


def id_of(key: str = "doc_id") -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))


def mark_of(text: str = "text", key: str = "doc_id") -> Column:
    """Tells rows with one id apart by their texts, and a null id from the id that stands for it."""
    return F.xxhash64(F.col(key).isNull(), F.col(text))


def one_of_each(docs: DataFrame, members: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of docs for each component: that with the component's id, of several the one with the least mark, of equal ones any.

    members: doc_id, mark (of mark_of()), component, component_id, a row for each of docs. Rows without component stay, all of
    them. The rows that go are broadcast by id and mark up to a bound, else joined by a shuffle."""
    some = members.where("component is not null").select(id_of().alias("_lectern_k"), F.col("mark").alias("_lectern_m"), "component", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("_head"))
    heads = some.where("_head")
    several = heads.groupBy("component").agg(F.min("_lectern_m").alias("low"), F.max("_lectern_m").alias("high")).where("low != high").select("component", "low")
    gone = some.where("not _head").select("_lectern_k", "_lectern_m").unionAll(heads.join(several, "component").where("_lectern_m != low").select("_lectern_k", "_lectern_m")).distinct()
    twice = heads.groupBy("_lectern_k", "_lectern_m").count().where("count > 1").select("_lectern_k", "_lectern_m")
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = docs.withColumns({"_lectern_k": id_of(key), "_lectern_m": mark_of(text, key)}).join(gone, ["_lectern_k", "_lectern_m"], "left_anti")
    if twice.limit(1).count():
        once = kept.join(twice, ["_lectern_k", "_lectern_m"], "left_semi").dropDuplicates(["_lectern_k", "_lectern_m"])
        kept = kept.join(twice, ["_lectern_k", "_lectern_m"], "left_anti").unionByName(once)
    return kept.select(*docs.columns)

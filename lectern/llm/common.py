"""What the operators of this package share: inputs, scratch tables in the shared folder, bounded broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that a broadcast may hold; beyond it the same rows are found by a shuffled join.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="lectern-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what stored() wrote inside, but the tables that kept() hands on to what stands around it."""
    _scopes.append([])
    try:
        yield
    finally:
        for df in _scopes.pop():
            dropped(df)


def kept(df: DataFrame) -> DataFrame:
    """A table of stored() that outlives the scratch() around it."""
    _scopes[-1] = [x for x in _scopes[-1] if x is not df]
    if len(_scopes) > 1:
        _scopes[-2].append(df)
    return df


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of queries that are over: it acts when the driver's JVM has collected their plans. Where events that
    listeners have not seen yet still hold some, these files stay until a later collection."""
    jvm = spark.sparkContext._jvm
    try:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    except Py4JJavaError:  # the events of a large job are still queued: no reason to end it
        pass
    gc.collect()
    jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing lazy reads it any more."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._lectern_path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def rows_in(df: DataFrame, ids: DataFrame, key: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is among ids: a broadcast of the ids up to bound of them, a shuffled semi-join beyond."""
    few = ids.select(key).distinct()
    if few.limit(bound + 1).count() <= bound:
        few = F.broadcast(few)
    return df.join(few, key, "left_semi")


@lru_cache
def _libc() -> ctypes.CDLL | None:
    try:
        found = ctypes.CDLL("libc.so.6")
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


def trimmed() -> None:
    """Gives memory that is free again back to the system, so that workers, which live on, don't keep what their largest task took."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch | pa.Table]], schema: str) -> DataFrame:
    """mapInArrow of f, which gets one record batch at a time; f() without arguments makes it, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = f()
        for batch in batches:
            if batch.num_rows:
                for out in g(batch):
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]
                del batch
                trimmed()

    return df.mapInArrow(run, schema)


def task_partition() -> int:
    return TaskContext.get().partitionId()


def as_text_id(col: str) -> F.Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))

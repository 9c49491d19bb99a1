"""A session for tests, the bench and small jobs; on a cluster the session is given."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | str = 8, partitions: int | None = None, memory: str = "8g", name: str = "lectern") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus)).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary folder in local mode only."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not found:
            found = tempfile.mkdtemp(prefix="lectern-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        context.setCheckpointDir(found)
    return context.getCheckpointDir().rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df computed once and kept as a checkpoint, for plans that read it several times."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Rows that a task of dealt() gets in the mean, at most.
TASK_ROWS = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to spark.sql.shuffle.partitions tasks, or as many more as keep each to TASK_ROWS rows. For rows that are cheap to count."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // TASK_ROWS)), *keys)


def written(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """df computed once and kept as a compressed table, for whole texts. It is deleted when the session ends; `instead`, a table written before that nothing
    but df has to read, is deleted now."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    place = hadoop(path)
    place.getFileSystem(conf).deleteOnExit(place)
    for old in {f.rsplit("/", 1)[0] for f in (instead.inputFiles() if instead is not None else [])}:
        if re.fullmatch("lectern-[0-9a-f]{32}", old.rsplit("/", 1)[-1]):
            hadoop(old).getFileSystem(conf).delete(hadoop(old), True)
    return spark.read.schema(df.schema).parquet(path)

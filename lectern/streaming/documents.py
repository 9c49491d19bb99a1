"""Streams of documents: new files as they come, each text once, activity in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions import text


def new_documents(spark: SparkSession, folder: str, schema: StructType | str, files_at_once: int = 100) -> DataFrame:
    """Rows of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def once(stream: DataFrame, time: str, late: str = "1 hour", column: str = "text") -> DataFrame:
    """The first row of each normalised text within the watermark; state is kept for that long only."""
    return stream.withWatermark(time, late).withColumn("_key", F.md5(text.alphanumeric(column).cast("binary"))).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def activity(stream: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums in windows of event time."""
    timed = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")

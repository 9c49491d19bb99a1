"""Files in and records out: scans by format, JSON files, batches with a result for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File endings and their media types.
MEDIA = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg"}


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def file_kind(path: Column) -> Column:
    """pdf, image or null."""
    e = ending(path)
    return F.when(e == ".pdf", "pdf").when(e.isin(".png", ".jpg", ".jpeg"), "image")


def is_supported(path: Column) -> Column:
    return ending(path).isin(*MEDIA)


def media_type(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])[ending(path)]


def scan(spark: SparkSession, folder: str, patterns: str = "*.pdf,*.png,*.jpg,*.jpeg", content: bool = True) -> DataFrame:
    """path, length, kind, media (and content) of the files that meet a comma-separated list of patterns, each once."""
    glob = "{" + ",".join(dict.fromkeys(p.strip() for p in patterns.split(",") if p.strip())) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length", file_kind(F.col("path")).alias("kind"), media_type(F.col("path")).alias("media"), *(["content"] if content else []))


def raw_text(df: DataFrame, layout: str = "layout_text", plain: str = "plain_text", ocr: str = "ocr_text", cached: str = "cached_text", most: int = 30_000, least: int = 200, any_length: bool = True) -> DataFrame:
    """df with text and text_source, by what the engines' columns hold: a PDF's layout text if it has between `least` and `most` characters, else plain
    text, else recognised text; an image's cached text if over 500 characters, else recognised text. Where none of these is there, a text of any other length
    is taken (any_length)."""
    n = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    pdf, image = F.col("kind") == "pdf", F.col("kind") == "image"
    source = F.when(pdf & n(layout).between(least, most), "layout").when(pdf & (n(plain) >= least), "plain").when(image & (n(cached) > 500), "cached").when(n(ocr) > 0, "ocr")
    if any_length:
        source = F.coalesce(source, F.when(pdf & (n(layout) > 0), "layout").when(pdf & (n(plain) > 0), "plain").when(image & (n(cached) > 0), "cached"))
    return df.withColumn("text_source", source).withColumn("text", F.when(source == "layout", F.col(layout)).when(source == "plain", F.col(plain)).when(source == "cached", F.col(cached)).when(source == "ocr", F.col(ocr)))


def json_records(df: DataFrame, fields: list[str], pretty: bool = False) -> DataFrame:
    """df with json: the given fields in this order; a null field is written as null, other columns not at all."""
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {})
    return df.withColumn("json", F.to_json(F.struct(*fields), options))


def write_batch(df: DataFrame, folder: str, key: str = "path") -> None:
    """One JSON text for each row that has one under records, and file, success and error of each under results."""
    df.where("json is not null").select("json").write.mode("errorifexists").text(f"{folder}/records")
    df.select(F.col(key).alias("file"), F.col("error").isNull().alias("success"), "error").write.mode("errorifexists").json(f"{folder}/results")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """path and json of whole JSON files."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("json"))

"""A corpus pipeline over documents: five stages, each an operator of lectern.llm whose decisions take effect."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontamination, mixing, ngram_join, quality, token_files
from lectern.llm.common import stored, table
from lectern.llm.queries import vocabulary
from lectern.llm.rows import kept_rows, none, one_of_each, positive


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier predicts to be good; it learns from the same labelled rows as its query."""
    model = quality.fitted(docs, quality.split_labels(table(spark, sf_dir, "labels"), "quality", 3, 1))
    return kept_rows(docs, partial(quality._score_task, model), "predicted", positive)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each component of documents whose sets of five-word shingles have similarity 0.8 or more."""
    return one_of_each(docs, ngram_join.jaccard_members(docs, k=5, percent=80))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents without any occurrence of ten words of a benchmark item."""
    chunks = decontamination.broadcast_items(table(spark, sf_dir, "benchmark"))
    return kept_rows(docs, partial(decontamination._task, chunks, 10), "n_hit", none)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document as often as the mix takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: token files of what is left, and their digest."""
    return token_files.token_digest(docs, vocabulary())


STAGES = [("quality", good_quality), ("near_copies", near_copies), ("benchmark", no_benchmark), ("mix", mix), ("tokens", tokens)]
#: SQL cannot express a stage's classifier; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Inputs of the queries, derived from the tables by expressions that read the same in Spark SQL and in ANSI SQL.

The tables hold no headers, identifiers or authors; these are added from keys, so that every operator has work on every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Text with two headers and identifiers.
HEADED = "concat('## Methods', chr(10), text, chr(10), '## Results', chr(10), 'word ', CAST(doc_id % 7 AS STRING), ' doi:10.', CAST(1000 + doc_id % 9000 AS STRING), '/x', CAST(doc_id AS STRING), '.')"
#: A whole text, then a sentence with one identifier of each scheme, some twice.
CITED = (
    "concat(coalesce(text, ''), ' See https://doi.org/10.', CAST(1000 + doc_id % 9000 AS STRING), '/ab.', CAST(doc_id AS STRING), '. and doi: 10.5555/z; arXiv:21', lpad(CAST(doc_id % 100 AS STRING), 2, '0'), '.', lpad(CAST(doc_id % 100000 AS STRING), 5, '0'), 'v2 by ',"
    " CASE WHEN doc_id % 3 = 0 THEN 'https://orcid.org/0000-0002-1825-0097' WHEN doc_id % 3 = 1 THEN '0000-0002-1825-009X 0000-0001-5109-3700' ELSE 'nobody' END,"
    " ' at https://ror.org/03yrm5c', lpad(CAST(doc_id % 90 + 10 AS STRING), 2, '0'), ' https://isni.org/isni/000000012146438X https://grid.ac/grid.', CAST(doc_id % 500 AS STRING), '.a', CASE WHEN doc_id % 2 = 0 THEN ' funded by 10.13039/100000001' ELSE '' END)"
)
#: Rights statements: exact, inexact, by address, known, junk and unknown ones.
RIGHTS = (
    "CASE doc_id % 12 WHEN 0 THEN 'CC-BY 4.0' WHEN 1 THEN 'Apache License, Version 2.0' WHEN 2 THEN 'MIT License' WHEN 3 THEN 'CC BY-NC 4.0' WHEN 4 THEN 'GNU General Public License, version 3' WHEN 5 THEN 'Creative Commons Atribution 4.0 International'"
    " WHEN 6 THEN 'BSD 3 Clause' WHEN 7 THEN 'public domain' WHEN 8 THEN 'https://creativecommons.org/licenses/by-sa/4.0/legalcode' WHEN 9 THEN 'All Rights Reserved' WHEN 10 THEN 'License' ELSE 'house rules' END"
)
#: A poster's head: title, authors with markers, a numbered list, a section.
HEAD = (
    "concat('Depth of the River ', CAST(doc_id AS STRING), chr(10), 'Jane Q. Doe1, Max van Dam1,2', CASE WHEN doc_id % 4 = 0 THEN ', Ana Lima3' ELSE '' END, chr(10), '1 University of Alder, Alder, 2 Institute of Boats, Birch',"
    " CASE WHEN doc_id % 8 = 0 THEN ', 3 Hospital of Cedar' ELSE '' END, chr(10), '## Abstract', chr(10), coalesce(text, ''))"
)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", *columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs of a page for each order: its line numbers and quantities give places, sizes and letters."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "1 AS page", "l_linenumber AS si", "CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE substr('abcdefghij', 1 + l_linenumber % 10, 1) END AS text",
        "l_quantity * 10 AS x0", "l_quantity * 10 + 6 AS x1", "CAST(l_partkey % 4 AS DOUBLE) * 20 AS top", "CAST(l_partkey % 4 AS DOUBLE) * 20 + 10 AS bottom",
        "CASE WHEN l_suppkey % 3 = 0 THEN 12.0D ELSE 10.0D END AS size", "CASE WHEN l_suppkey % 4 = 0 THEN 'Sans-Bold' ELSE 'Sans' END AS fontname", "true AS upright",
    )

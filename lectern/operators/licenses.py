"""Licenses: an alias table joined exactly, then by integers and one edit; rights lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed, text


def license_table(spark: SparkSession) -> DataFrame:
    """spdx, name, uri: one row for each license."""
    return spark.createDataFrame([(s, n, u) for s, n, u, _ in fixed.LICENSES], "spdx string, name string, uri string")


def alias_table(spark: SparkSession) -> DataFrame:
    """stripped (unique), spdx; a later name wins a stripped key."""
    rows = {re.sub("[^a-z0-9]", "", a.lower()): s for s, _, _, names in fixed.LICENSES for a in names}
    return spark.createDataFrame(sorted(rows.items()), "stripped string, spdx string")


def fuzzy_table(spark: SparkSession) -> DataFrame:
    """ints (joined by commas), alpha, spdx: keys of the inexact match; an earlier license keeps a key."""
    rows: dict[tuple[str, str], str] = {}
    for s, _, _, names in fixed.LICENSES:
        for a in names:
            rows.setdefault((",".join(str(int(x)) for x in re.findall(r"\d+", a)), re.sub("[^a-z]", "", a.lower())), s)
    return spark.createDataFrame([(*k, v) for k, v in sorted(rows.items())], "ints string, alpha string, spdx string")


def matched(df: DataFrame, column: str = "rights") -> DataFrame:
    """df with spdx: of the alias with the same letters and digits; else of the only license whose integers are equal and
    whose letters differ by one edit at most. Distinct texts are matched once; the alias tables are a hundred rows."""
    spark = df.sparkSession
    texts = df.select(F.col(column).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    texts = texts.withColumns({"stripped": text.alnum_key("_t"), "ints": F.array_join(text.integers_key("_t"), ","), "alpha": text.letters_key("_t")})
    texts = texts.join(F.broadcast(alias_table(spark)), "stripped", "left")
    near = fuzzy_table(spark).withColumnsRenamed({"alpha": "_a", "spdx": "_s"})
    near = texts.where(F.col("spdx").isNull() & (F.col("alpha") != "")).join(F.broadcast(near), "ints").where(F.levenshtein("alpha", "_a", 1) >= 0)
    near = near.groupBy("_t").agg(F.countDistinct("_s").alias("_n"), F.min("_s").alias("_near")).where("_n = 1").select("_t", "_near")
    texts = texts.join(near, "_t", "left").select("_t", F.coalesce("spdx", "_near").alias("spdx"))
    return df.join(texts, F.col(column) == F.col("_t"), "left").drop("_t")


def cc_spdx(c: Column) -> Column:
    """License id of a Creative Commons address in the text; null without one."""
    pattern = r"(?i)https?://creativecommons\.org/(?:licenses|publicdomain)/([-a-z]+)/(\d+\.\d+)"
    slug = F.lower(F.regexp_extract(c, pattern, 1))
    prefix = F.create_map(*[F.lit(x) for kv in fixed.CC_SLUGS.items() for x in kv])[slug]
    return F.when(prefix.isNotNull(), F.concat(prefix, F.lit("-"), F.regexp_extract(c, pattern, 2)))


def rights_entries(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entries key, pos, rights, rightsIdentifier, rightsUri to normalised ones with action: known, url, match, keep or drop.

    In this order: known statements without an id stay; a Creative Commons address of a license in the table decides; a name, id or
    address that matches; junk in the whole or in a value goes; the rest stays as it is."""
    spark = df.sparkSession
    c = {x: F.coalesce(F.col(x), F.lit("")) for x in ("rights", "rightsIdentifier", "rightsUri")}
    whole = F.btrim(F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in c.values()]))
    out = df.withColumn("_known", F.lower(F.btrim(c["rightsIdentifier"])).isin(*fixed.KNOWN_RIGHTS) | F.lower(F.btrim(c["rights"])).isin(*fixed.KNOWN_RIGHTS))
    out = out.withColumn("_url", F.coalesce(cc_spdx(c["rightsUri"]), cc_spdx(c["rights"]), cc_spdx(whole)))
    ids = [r[0] for r in fixed.LICENSES]
    out = out.withColumn("_url", F.when(F.col("_url").isin(*ids), F.col("_url")))
    for x in c:
        out = matched(out, x).withColumnRenamed("spdx", f"_by_{x}")
    out = out.withColumn("_spdx", F.coalesce("_url", "_by_rights", "_by_rightsIdentifier", "_by_rightsUri"))
    junk = text.is_rights_junk(whole)
    for x in c.values():
        junk = junk | ((F.btrim(x) != "") & text.is_rights_junk(x))
    action = F.when(F.col("_known"), "known").when(F.col("_url").isNotNull(), "url").when(F.col("_spdx").isNotNull(), "match").when(junk, "drop").otherwise("keep")
    out = out.withColumn("action", action).join(F.broadcast(license_table(spark)), (F.col("_spdx") == F.col("spdx")) & ~F.col("_known"), "left")
    hit = F.col("spdx").isNotNull()
    return out.select(key, "pos", F.when(hit, F.col("name")).otherwise(F.col("rights")).alias("rights"), F.when(hit, F.col("spdx")).otherwise(F.col("rightsIdentifier")).alias("rightsIdentifier"), F.when(hit, "SPDX").alias("rightsIdentifierScheme"), F.when(hit, "https://spdx.org/licenses/").alias("schemeUri"), F.when(hit & ((F.col("action") == "url") | (c["rightsUri"] == "")), F.col("uri")).otherwise(F.col("rightsUri")).alias("rightsUri"), "action")

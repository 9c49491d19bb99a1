"""Lookups in registries as joins: organisations, persons, funders. A registry is a DataFrame, so a lookup needs no network."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.session import written

#: Rows of a registry's names that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_NAMES = 200_000


def _small(names: DataFrame) -> DataFrame:
    return F.broadcast(names) if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else names


def _names(orgs: DataFrame) -> DataFrame:
    """org_id, display_name, name key of every name, once each."""
    return orgs.select("org_id", "display_name", F.explode(F.array_distinct(F.concat(F.array("display_name"), F.coalesce("names", F.array().cast("array<string>"))))).alias("n")).select("org_id", "display_name", text.match_key("n").alias("name")).where("name != ''").distinct()


def organisations(affiliations: DataFrame, orgs: DataFrame, name: str = "name") -> DataFrame:
    """affiliations with org_id and org_name where the text is an organisation: equal to one of its names, or such a name and an address.

    A text that only contains a name (a department, a centre) gets nothing. Distinct keys are looked up once. Equality is tried first, with and
    without a country at the end; then each prefix of the key that ends at a comma. The longest name wins, then the smaller id."""
    names = _names(orgs)
    keys = affiliations.select(F.col(name).alias("_raw")).where("_raw is not null").distinct().withColumn("key", text.match_key("_raw")).where("key != ''")
    cut = F.transform(F.sequence(F.lit(1), F.size(F.split("key", ","))), lambda i: F.btrim(F.array_join(F.slice(F.split("key", ","), F.lit(1), i), ",")))
    tried = keys.select("_raw", "key", F.explode(F.array_distinct(F.concat(F.array(F.col("key")), cut))).alias("name"))
    hits = tried.join(_small(names), "name").withColumn("tail", F.regexp_replace(F.substr(F.col("key"), F.length("name") + 1), "^[ ,.;]+", ""))
    hits = hits.where(text.address_tail("tail"))
    best = hits.withColumn("_i", F.row_number().over(Window.partitionBy("_raw").orderBy(F.length("name").desc(), "org_id"))).where("_i = 1")
    best = best.select("_raw", "org_id", F.col("display_name").alias("org_name"))
    return affiliations.join(best, F.col(name) == F.col("_raw"), "left").drop("_raw")


#: Weights of name tokens are whole numbers, so that sums and comparisons are exact; the least similarity in percent.
WEIGHT, ALIKE = 1000, 95


def name_tokens(key: Column) -> Column:
    return F.regexp_extract_all(key, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _weighted(entries: DataFrame, weights: DataFrame, most: int, *keys: str) -> DataFrame:
    """keys, tokens (structs of weight and token, the heaviest, which is the rarest, first), total; entries: keys, words. A token without a weight has the most."""
    flat = entries.select(*keys, F.explode(F.array_distinct("words")).alias("token")).join(weights, "token", "left").withColumn("w", F.coalesce("w", F.lit(most)))
    own = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("less"), "token")))
    return flat.groupBy(*keys).agg(F.transform(own, lambda x: F.struct((-x["less"]).alias("w"), x["token"].alias("token"))).alias("tokens"), F.sum("w").alias("total"))


def spelled(words: Column | str) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def tokens_of(weighted: Column | str) -> Column:
    return F.transform(weighted, lambda x: x["token"])


def candidates(asked: DataFrame, orgs: DataFrame, name: str = "name", alike: int = ALIKE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """id, own_id of asked and registry names that may match; the distinct names asked for with their keys, the keys by id, the registry's names by own_id.

    Candidates meet in a key. A phrase of as many words as a registry name has is the name's own key. Two alike names can differ in little weight: a token of more than
    that is in both, so their heavy tokens, all of them together, are a key (with the level of the total, which is the same or the next). Where no token is
    heavy, the registry name is filed under its rarest tokens: those without which less than that share of its weight could be met. So no popular token is joined on,
    but for names that have no other; and every pair that has met is compared as it is, so that a key in common by chance adds nothing."""
    # Both sides are read once: what they come from may cost more than all the rest.
    entries = written(_names(orgs)).withColumn("words", name_tokens(F.col("name"))).where(F.size("words") > 0)
    n = entries.count()
    df = entries.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").count()
    weigh = lambda count: F.floor(WEIGHT * F.log(1 + F.lit(float(n)) / count)).cast("long")
    weights = _small(df.select("token", weigh(F.col("count")).alias("w")))
    most = int(WEIGHT * math.log(1 + n))
    of_key = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    # A name that many organisations have is compared once, for the smallest id.
    named = entries.groupBy("name").agg(F.min(F.struct("org_id", "display_name")).alias("o")).select("o.org_id", "o.display_name", F.col("name").alias("own_name"), name_tokens(F.col("name")).alias("words"), of_key("name").alias("own_id"))
    lengths = sorted(r[0] for r in named.select(F.size("words")).distinct().collect())
    known = written(named.join(_weighted(named.select("own_id", "words"), weights, most, "own_id"), "own_id"))
    keys = written(asked.select(F.col(name).alias("_raw")).where("_raw is not null").distinct().withColumn("key", text.match_key("_raw")))
    distinct = keys.select("key").distinct().withColumns({"words": name_tokens(F.col("key")), "id": of_key("key")})
    asking = written(distinct.join(_weighted(distinct.select("id", "words"), weights, most, "id"), "id"))

    before = lambda i: F.aggregate(F.slice("tokens", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["w"])
    rarest = tokens_of(F.filter("tokens", lambda x, i: before(i) * 100 <= (100 - alike) * F.col("total")))
    # Of two alike names, what is in one and not in the other weighs this share of the lighter total at most, and the totals have this ratio at most; a little more, as logarithms are not exact.
    apart, ratio = 1.0001 * (100 - alike) / alike, 1.001 * 100 / alike

    def at_level(level: Column, rare: Column) -> Column:
        heavy = tokens_of(F.filter("tokens", lambda x: x["w"] > apart * F.pow(F.lit(ratio), level + 1)))
        return F.when(F.size(heavy) > 0, F.array(F.xxhash64(level, heavy))).otherwise(F.transform(rare, lambda t: F.xxhash64(level, t)))

    def met_in(df: DataFrame, id_: str, rare: Column, phrases: Column) -> DataFrame:
        level = F.floor(F.log("total") / math.log(ratio))
        return df.select(id_, F.explode(F.array_distinct(F.concat(at_level(level, rare), at_level(level - 1, rare), phrases))).alias("h"))

    phrases = F.flatten(F.array(*[text.gram_keys(F.col("words"), k) for k in lengths])) if lengths else F.array().cast("array<bigint>")
    met = met_in(asking, "id", tokens_of("tokens"), phrases).join(_small(met_in(known, "own_id", rarest, F.array(F.xxhash64("words")))), "h").select("id", "own_id").distinct()
    return met, keys, asking, known


def matches(asked: DataFrame, orgs: DataFrame, name: str = "name", alike: int = ALIKE) -> DataFrame:
    """name, org_id, org_name, score, phrase: of each distinct name the registry's best match, exact or not; names without one are not there.

    A registry name that stands in the text word for word is a match (the longest of them); else the one of highest similarity, which is the weight
    of shared tokens over that of all, if it is alike percent at least. Ties go to the smaller id. A token weighs 1000 * ln(1 + names / names with it)."""
    met, keys, asking, known = candidates(asked, orgs, name, alike)
    own = known.select("own_id", "org_id", "display_name", "own_name", F.col("tokens").alias("own"), F.col("total").alias("own_total"), spelled("words").alias("own_spelled"))
    tried = met.join(asking.select("id", "key", "total", tokens_of("tokens").alias("have"), spelled("words").alias("spelled")), "id").join(own, "own_id")
    shared = F.aggregate(F.filter("own", lambda x: F.array_contains("have", x["token"])), F.lit(0).cast("long"), lambda a, x: a + x["w"])
    scored = tried.withColumns({"shared": shared, "phrase": F.contains("spelled", "own_spelled")}).withColumn("all", F.col("total") + F.col("own_total") - F.col("shared"))
    good = scored.where(f"phrase or shared * 100 >= {alike} * all").withColumn("score", F.col("shared") / F.col("all"))
    order = Window.partitionBy("key").orderBy(F.desc("phrase"), F.when(F.col("phrase"), F.length("own_name")).desc_nulls_last(), F.desc("score"), "org_id")
    best = good.withColumn("_i", F.row_number().over(order)).where("_i = 1").select("key", "org_id", F.col("display_name").alias("org_name"), "score", "phrase")
    return keys.select(F.col("_raw").alias(name), "key").join(best, "key").drop("key")


def persons(creators: DataFrame, registry: DataFrame, key: str = "creator_id", orgs: DataFrame | None = None) -> DataFrame:
    """creators (given, family, affiliations) with orcid: of the only person with these names (accents and case aside) at one of the affiliations, or, with orgs, at one
    that an affiliation is taken for, exact or not.

    Given name, family name and at least one affiliation are needed; two persons give none."""
    asked = creators.where((F.coalesce("given", F.lit("")) != "") & (F.coalesce("family", F.lit("")) != "") & (F.size("affiliations") > 0))
    asked = asked.select(key, text.match_key("given").alias("g"), text.match_key("family").alias("f"), F.explode("affiliations").alias("org"))
    if orgs is not None:
        chosen = matches(asked.select("org"), orgs, "org").select("org", "org_name")
        asked = asked.join(chosen, "org", "left").select(key, "g", "f", F.explode(F.array_compact(F.array("org", "org_name"))).alias("org"))
    asked = asked.withColumn("org", F.lower(F.btrim("org")))
    known = registry.select("orcid", text.match_key("given").alias("g"), text.match_key("family").alias("f"), F.explode(F.transform("orgs", lambda a: F.lower(F.btrim(a)))).alias("org"))
    hits = asked.join(known, ["g", "f", "org"]).select(key, "orcid").distinct()
    one = hits.groupBy(key).agg(F.count("*").alias("n"), F.min("orcid").alias("orcid")).where("n = 1").select(key, "orcid")
    return creators.join(one, key, "left")


def funders(references: DataFrame, orgs: DataFrame, name: str = "funderName") -> DataFrame:
    """references with the identifier of the funder of that name, or that the name is taken for: its FundRef DOI, else its registry address; others as they are.

    A name that is taken for an organisation which is no funder gets nothing."""
    funding = orgs.where(F.array_contains("types", "funder")).select("org_id", "display_name", "fundref")
    open_ = references.where((F.coalesce("funderIdentifier", F.lit("")) == "") & F.col(name).isNotNull()).select(F.col(name).alias("_raw")).distinct()
    names = _names(orgs).join(funding.select("org_id", "fundref"), "org_id")
    equal = names.groupBy("name").agg(F.min(F.struct("org_id", "display_name", "fundref")).alias("o"))
    same = open_.withColumn("name", text.match_key("_raw")).join(_small(equal), "name").select("_raw", "o")
    rest = matches(open_.join(same, "_raw", "left_anti"), orgs, "_raw").select("_raw", "org_id").join(funding, "org_id").select("_raw", F.struct("org_id", "display_name", "fundref").alias("o"))
    keyed = references.join(same.unionByName(rest), F.col(name) == F.col("_raw"), "left").drop("_raw")
    new = (F.coalesce("funderIdentifier", F.lit("")) == "") & F.col("o").isNotNull()
    doi = F.col("o.fundref").isNotNull()
    return keyed.withColumns({
        name: F.when(new, F.col("o.display_name")).otherwise(F.col(name)),
        "funderIdentifierType": F.when(new, F.when(doi, "Crossref Funder ID").otherwise("ROR")).otherwise(F.col("funderIdentifierType")),
        "schemeUri": F.when(new, F.coalesce("schemeUri", F.when(doi, "https://doi.org/10.13039").otherwise("https://ror.org"))).otherwise(F.col("schemeUri")),
        "funderIdentifier": F.when(new, F.when(doi, F.concat(F.lit("https://doi.org/10.13039/"), "o.fundref")).otherwise(F.col("o.org_id"))).otherwise(F.col("funderIdentifier")),
    }).drop("o")

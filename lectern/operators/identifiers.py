"""Identifiers in text and in records: found, typed, canonical, placed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed


def canonical_doi(c: Column) -> Column:
    """The bare DOI of any of its forms; other values as they are."""
    bare = F.btrim(F.regexp_replace(c, fixed.DOI_PREFIX, ""))
    return F.when(bare.startswith("10."), bare).otherwise(c)


def scheme_key(c: Column) -> Column:
    """orcid, crossref_funder, doi, arxiv, ror, isni, grid, by the first rule that the value meets; else null."""
    v, out = F.btrim(c), F
    for key, pattern in fixed.OF_VALUE:
        out = out.when(v.rlike(pattern), key)
    return out.otherwise(F.lit(None).cast("string"))


def _named(key: Column, which: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in fixed.SCHEMES.items() for x in (k, v[which])])[key]


def scheme(c: Column) -> Column:
    """struct(scheme, scheme_uri); null for an unknown value."""
    key = scheme_key(c)
    return F.when(key.isNotNull(), F.struct(_named(key, 0).alias("scheme"), _named(key, 1).alias("scheme_uri")))


def found(text: Column) -> Column:
    """Map of scheme to its distinct values in order; schemes without values are left out."""
    values = {k: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for k, p in fixed.IN_TEXT.items()}
    values["crossref_funder"] = F.transform(values["crossref_funder"], lambda x: F.concat(F.lit("10.13039/"), x))
    values["doi"] = F.filter(F.transform(values["doi"], lambda x: F.regexp_replace(x, r"\.+$", "")), lambda x: ~x.startswith("10.13039/"))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.array_distinct(v).alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))


def found_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Long form: doc_id, scheme, pos, value."""
    return docs.select(F.col(key), F.explode(found(F.col(text))).alias("scheme", "values")).select(key, "scheme", F.posexplode("values").alias("pos", "value"))


def orcid_url(c: Column) -> Column:
    """A bare ORCID as an address; addresses and other values as they are."""
    bare = F.regexp_extract(c, r"((?:\d{4}-){3}\d{3}[\dX])\b", 1)
    return F.when((bare != "") & ~c.startswith("http"), F.concat(F.lit("https://orcid.org/"), bare)).otherwise(c)


def typed_identifiers(items: Column) -> Column:
    """array<struct<identifier, identifierType>>: missing types filled, DOIs canonical."""

    def one(x: Column) -> Column:
        s = scheme(x["identifier"])
        return F.struct(F.when(s["scheme"] == "DOI", canonical_doi(x["identifier"])).otherwise(x["identifier"]).alias("identifier"), F.coalesce(F.nullif(x["identifierType"], F.lit("")), s["scheme"]).alias("identifierType"))

    return F.transform(items, one)


def typed_affiliations(items: Column) -> Column:
    """array<struct<name, affiliationIdentifier, affiliationIdentifierScheme, schemeUri>>: bare ROR ids as addresses, with their scheme."""

    def one(a: Column) -> Column:
        full = F.when(a["affiliationIdentifier"].rlike(r"^0[a-z0-9]{6}\d{2}$"), F.concat(F.lit("https://ror.org/"), a["affiliationIdentifier"])).otherwise(a["affiliationIdentifier"])
        ror = F.coalesce(F.contains(full, F.lit("ror.org/")), F.lit(False))
        return F.struct(a["name"].alias("name"), full.alias("affiliationIdentifier"), F.when(ror, F.coalesce(F.nullif(a["affiliationIdentifierScheme"], F.lit("")), F.lit("ROR"))).otherwise(a["affiliationIdentifierScheme"]).alias("affiliationIdentifierScheme"), F.when(ror, F.coalesce(a["schemeUri"], F.lit("https://ror.org/"))).otherwise(a["schemeUri"]).alias("schemeUri"))

    return F.transform(items, one)


def typed_funding(items: Column) -> Column:
    """array<struct<funderName, funderIdentifier, funderIdentifierType, schemeUri, ...>>: types and schemes filled, funder DOIs as addresses."""

    def one(r: Column) -> Column:
        s, bare = scheme(r["funderIdentifier"]), canonical_doi(r["funderIdentifier"])
        known = F.coalesce(s["scheme"] == "Crossref Funder ID", F.lit(False)) & bare.startswith("10.13039/")
        return r.withField("funderIdentifierType", F.coalesce(F.nullif(r["funderIdentifierType"], F.lit("")), s["scheme"])).withField("schemeUri", F.coalesce(F.nullif(r["schemeUri"], F.lit("")), s["scheme_uri"])).withField("funderIdentifier", F.when(known, F.concat(F.lit("https://doi.org/"), bare)).otherwise(r["funderIdentifier"]))

    return F.transform(items, one)


def typed_related(items: Column) -> Column:
    def one(r: Column) -> Column:
        doi = (F.coalesce(r["relatedIdentifierType"], F.lit("")) == "DOI") | r["relatedIdentifier"].rlike(fixed.DOI_PREFIX)
        return r.withField("relatedIdentifier", F.when(doi, canonical_doi(r["relatedIdentifier"])).otherwise(r["relatedIdentifier"]))

    return F.transform(items, one)


def placed_identifiers(existing: Column, dois: Column, arxiv: Column) -> Column:
    """existing, then DOIs and arXiv ids of the text that it does not hold (case does not count)."""
    empty = F.array().cast("array<string>")
    old = F.transform(F.coalesce(existing, F.array().cast("array<struct<identifier:string,identifierType:string>>")), lambda x: F.lower(x["identifier"]))
    new_dois = F.filter(F.coalesce(dois, empty), lambda d: ~F.array_contains(old, F.lower(d)))
    new_arxiv = F.filter(F.coalesce(arxiv, empty), lambda a: ~F.array_contains(old, F.lower(a)) & ~F.array_contains(old, F.concat(F.lit("arxiv:"), F.lower(a))))
    made = lambda v, kind, head: F.transform(v, lambda x: F.struct(F.concat(F.lit(head), x).alias("identifier"), F.lit(kind).alias("identifierType")))
    return F.concat(F.coalesce(existing, F.array().cast("array<struct<identifier:string,identifierType:string>>")), made(new_dois, "DOI", ""), made(new_arxiv, "arXiv", "arXiv:"))


def placed_orcids(per_creator: Column, orcids: Column) -> Column:
    """array<array<string>> of creators' ORCID addresses with those of the text: by position if as many as creators, else all to the first."""
    bare = F.transform(F.flatten(per_creator), lambda x: F.regexp_extract(x, r"((?:\d{4}-){3}\d{3}[\dX])\b", 1))
    new = F.array_except(F.coalesce(orcids, F.array().cast("array<string>")), bare)
    url = lambda x: F.concat(F.lit("https://orcid.org/"), x)
    by_place = F.zip_with(per_creator, new, lambda own, x: F.concat(own, F.array(url(x))))
    to_first = F.transform(per_creator, lambda own, i: F.when(i == 0, F.concat(own, F.transform(new, url))).otherwise(own))
    return F.when((F.size(new) == 0) | (F.size(per_creator) == 0), per_creator).when(F.size(new) == F.size(per_creator), by_place).otherwise(to_first)


def placed_funders(refs: Column, funder_ids: Column, more: tuple[str, ...] = ()) -> Column:
    """Funder ids of the text go in turn to references without one; ids left over get references of their own. more: the names of
    further text fields of refs."""
    url = lambda x: F.concat(F.lit("https://doi.org/"), x)
    have = F.transform(F.filter(refs, lambda r: r["funderIdentifier"].isNotNull()), lambda r: F.lower(r["funderIdentifier"]))
    new = F.filter(funder_ids, lambda x: ~F.array_contains(have, F.lower(x)) & ~F.array_contains(have, F.lower(url(x))))
    open_ = lambda r: F.coalesce(r["funderIdentifier"], F.lit("")) == ""
    rank = lambda i: F.size(F.filter(F.slice(refs, F.lit(1), i + 1), open_))

    def one(r: Column, i: Column) -> Column:
        mine = F.when(open_(r), F.try_element_at(new, rank(i)))
        return r.withField("funderIdentifier", F.coalesce(url(mine), r["funderIdentifier"])).withField("funderIdentifierType", F.when(mine.isNotNull(), "Crossref Funder ID").otherwise(r["funderIdentifierType"])).withField("schemeUri", F.when(mine.isNotNull(), "https://doi.org/10.13039").otherwise(r["schemeUri"]))

    n = F.size(F.filter(refs, open_))
    rest = F.when(F.size(new) > n, F.slice(new, n + 1, F.greatest(F.size(new) - n, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    made = F.transform(rest, lambda x: F.struct(F.lit("Unknown Funder").alias("funderName"), url(x).alias("funderIdentifier"), F.lit("Crossref Funder ID").alias("funderIdentifierType"), F.lit("https://doi.org/10.13039").alias("schemeUri"), *[F.lit(None).cast("string").alias(k) for k in more]))
    return F.concat(F.transform(refs, one), made)


def page_links(html: Column) -> Column:
    """Distinct addresses that a page links to, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1)))


def related_links(links: Column, existing: Column) -> Column:
    """Links that become references: no mail, no license page, nothing with a known identifier, nothing that is there already."""
    skip = lambda u: u.rlike(r"(?i)^mailto:") | u.rlike(r"(?i)creativecommons\.org|opensource\.org/licenses|spdx\.org") | u.rlike(r"(?i)orcid\.org|doi\.org|arxiv\.org|ror\.org|isni\.org|grid\.ac") | scheme_key(u).isNotNull() | F.array_contains(F.transform(existing, lambda e: F.lower(e)), F.lower(u))
    return F.transform(F.filter(links, lambda u: ~skip(u)), lambda u: F.struct(u.alias("relatedIdentifier"), F.lit("URL").alias("relatedIdentifierType"), F.lit("References").alias("relationType")))

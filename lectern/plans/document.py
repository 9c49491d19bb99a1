"""From documents to metadata records: one declarative plan over lines, sections, captions, creators, funding and identifiers."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed, text
from lectern.operators import identifiers, language, lines, people, records, registry
from lectern.session import written
from lectern.sources.adapters import Options

_FUNDING = "array<struct<funderName:string,funderIdentifier:string,funderIdentifierType:string,schemeUri:string,awardTitle:string,awardNumber:string,awardUri:string>>"
_IDS = "array<struct<identifier:string,identifierType:string>>"
_RELATED = "array<struct<relatedIdentifier:string,relatedIdentifierType:string,relationType:string>>"
_SECTIONS = "struct<sections:array<struct<sectionTitle:string,sectionContent:string>>>"
CONTENT = (
    f"struct<creators:array<struct<name:string,givenName:string,familyName:string,nameIdentifiers:array<struct<nameIdentifier:string>>>>,titles:array<struct<title:string>>,subjects:array<variant>,descriptions:variant,content:{_SECTIONS},"
    f"researchField:string,domain:string,posterContent:{_SECTIONS},fundingReferences:{_FUNDING},identifiers:{_IDS},relatedIdentifiers:{_RELATED}>"
)
_MARKER = r"(?m)^\[[^\]\n]*extracted\][ \t]*$"
_NAMES = "array<string>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def parsed(responses: DataFrame) -> DataFrame:
    """doc_id, json, r, v: a response repaired and read, as a struct and as a variant; renamed fields take their new names."""
    x = responses.withColumn("json", records.repaired_json(F.col("response")))
    x = x.withColumn("r", F.from_json("json", CONTENT)).withColumn("v", F.try_parse_json("json"))
    return x.withColumn("r", F.col("r").withField("content", F.coalesce("r.content", "r.posterContent")).withField("researchField", F.coalesce("r.researchField", "r.domain")).dropFields("posterContent", "domain"))


def _model_creators(v: Column) -> Column:
    """Creators as the response has them; affiliations may be strings, objects or lists of either. Placeholder people and affiliations go."""
    one = lambda c: F.struct(
        F.try_variant_get(c, "$.givenName", "string").alias("given"), F.try_variant_get(c, "$.familyName", "string").alias("family"), F.try_variant_get(c, "$.name", "string").alias("name"),
        text.without_placeholder_affiliations(F.transform(F.coalesce(records.affiliations(F.try_variant_get(c, "$.affiliation", "variant")), _none("array<struct<name:string>>")), lambda a: a["name"])).alias("affiliations"),
    )
    items = F.coalesce(F.try_variant_get(v, "$.creators", "array<variant>"), _none("array<variant>"))
    return F.filter(F.transform(items, one), lambda c: ~F.coalesce(text.is_placeholder_person(c["name"], c["given"], c["family"]), F.lit(False)))


def _given_identifiers(v: Column) -> Column:
    """Name identifiers of the response's creators, by name; bare ORCIDs as addresses."""
    items = F.coalesce(F.try_variant_get(v, "$.creators", "array<variant>"), _none("array<variant>"))
    ids = lambda c: F.transform(F.coalesce(F.try_variant_get(c, "$.nameIdentifiers", "array<struct<nameIdentifier:string>>"), _none("array<struct<nameIdentifier:string>>")), lambda n: identifiers.orcid_url(n["nameIdentifier"]))
    named = F.transform(items, lambda c: F.struct(F.coalesce(F.try_variant_get(c, "$.name", "string"), F.lit("")).alias("name"), F.filter(ids(c), lambda u: F.coalesce(u, F.lit("")) != "").alias("ids")))
    return records.first_of_each(F.filter(named, lambda n: F.size(n["ids"]) > 0), lambda n: n["name"])


def _split_joined(creators: Column) -> Column:
    """"A B & C D" in one name becomes two creators with the same affiliations."""
    parts = lambda c: people.split_joined(F.coalesce(c["name"], F.lit("")))
    many = lambda c: F.transform(parts(c), lambda n: F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"), n.alias("name"), c["affiliations"].alias("affiliations")))
    return F.flatten(F.transform(creators, lambda c: F.when(F.size(parts(c)) > 1, many(c)).otherwise(F.array(c))))


def captions_of(x: DataFrame) -> DataFrame:
    """x with images, tables (arrays of id and caption) and caption_texts: what the layout found (found_captions: kind, text), then what the response
    adds to it; placeholders go."""
    real = lambda kind, name: F.filter(F.transform(records.captions(F.try_variant_get("v", f"$.{name}", "variant"), kind), lambda c: c["caption"]), lambda c: ~text.is_placeholder(c))
    found = lambda kind: F.transform(F.filter("found_captions", lambda c: c["kind"] == kind), lambda c: text.spaced(c["text"]))
    numbered = lambda c, kind: F.transform(c, lambda t, i: F.struct(F.concat(F.lit(kind), (i + 1).cast("string")).alias("id"), t.alias("caption")))
    x = x.withColumns({"_i": lines.merged_captions(found("figure"), F.coalesce(real("fig", "imageCaptions"), _none(_NAMES)), F.col("text")), "_t": lines.merged_captions(found("table"), F.coalesce(real("table", "tableCaptions"), _none(_NAMES)), F.col("text"))})
    return x.withColumns({"images": numbered(F.col("_i"), "fig"), "tables": numbered(F.col("_t"), "table"), "caption_texts": F.concat("_i", "_t")}).drop("_i", "_t")


def sections_of(x: DataFrame, options: Options) -> DataFrame:
    """doc_id, sections, n_reclaimed: the response's sections without markdown and captions; then lines of the text that no field holds; for documents without
    any section those of the text's own headers. One copy of each content stays."""
    own = x.select("doc_id", "caption_texts", F.posexplode("own").alias("pos", "s")).select("doc_id", "pos", F.col("s.sectionTitle").alias("title"), lines.captions_removed(text.without_markdown(F.col("s.sectionContent")), F.col("caption_texts")).alias("content"))
    marked = lines.marked_headers(lines.lines_of(x.select("doc_id", "text")))
    parts = [own.select("doc_id", "pos", "title", "content", F.lit(0).alias("rank"))]
    has = own.select("doc_id").distinct()
    if options.reclaim_lines:
        meta = x.select("doc_id", F.explode(F.concat(F.array("title"), F.transform("creators", lambda c: c["name"]), F.flatten(F.transform("creators", lambda c: c["affiliations"])))).alias("text")).where("text is not null")
        held = reduce(DataFrame.unionByName, [own.select("doc_id", F.concat_ws("\n", "title", "content").alias("text")), meta, x.select("doc_id", F.explode("caption_texts").alias("text"))])
        free = lines.uncaptured(marked.where("not header").select("doc_id", "pos", "line"), held, meta)
        parts.append(lines.reclaimed(marked, free).join(has, "doc_id", "left_semi").select("doc_id", "pos", "title", "content", F.lit(1).alias("rank")))
    parts.append(lines.section_rows(marked.select("doc_id", "pos", "line")).join(has, "doc_id", "left_anti").select("doc_id", "pos", "title", "content", F.lit(2).alias("rank")))
    every = reduce(DataFrame.unionByName, parts).withColumn("pos", F.struct("rank", "pos"))
    kept = records.sections(every)
    section = F.struct("pos", F.struct(F.col("title").alias("sectionTitle"), F.col("content").alias("sectionContent")).alias("s"))
    return kept.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(section)), lambda y: y["s"]).alias("sections"), F.count(F.when(F.col("pos.rank") == 1, 1)).alias("n_reclaimed"))


def _with_registries(x: DataFrame, options: Options) -> DataFrame:
    """x with creators' organisations and ORCIDs, and funders, of the registries that the options name; each distinct name is looked up once. Without a registry of
    organisations, one is made by the options' lookups of the names that have no identifier."""
    if options.orgs is None and options.lookups is not None:
        open_ = F.filter("funding", lambda f: F.coalesce(f["funderIdentifier"], F.lit("")) == "")
        names = x.select(F.explode(F.concat(F.flatten(F.transform("creators", lambda c: c["affiliations"])), F.transform(open_, lambda f: f["funderName"]))).alias("name"))
        options = replace(options, orgs=options.lookups(names.where("btrim(name) != ''").distinct()))
    if options.orgs is not None:
        names = x.select(F.explode(F.flatten(F.transform("creators", lambda c: c["affiliations"]))).alias("name")).distinct()
        known = registry.organisations(names, options.orgs).where("org_id is not null")
        flat = x.select("doc_id", F.explode(F.flatten(F.transform("creators", lambda c: c["affiliations"]))).alias("name")).distinct().join(known, "name")
        per_doc = flat.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("org_id", "org_name")))).alias("orgs"))
        x = x.join(per_doc, "doc_id", "left")
    else:
        x = x.withColumn("orgs", F.lit(None).cast("map<string,struct<org_id:string,org_name:string>>"))
    if options.persons is not None:
        asked = x.select("doc_id", F.posexplode("creators").alias("i", "c")).select(F.struct("doc_id", "i").alias("creator_id"), "c.given", "c.family", "c.affiliations")
        hits = registry.persons(asked, options.persons, orgs=options.orgs).where("orcid is not null").select("creator_id.doc_id", F.col("creator_id.i").alias("i"), "orcid")
        x = x.join(hits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "orcid"))).alias("orcids")), "doc_id", "left")
    else:
        x = x.withColumn("orcids", F.lit(None).cast("map<int,string>"))
    if options.orgs is not None:
        refs = x.select("doc_id", F.posexplode("funding").alias("i", "f")).select("doc_id", "i", "f.*")
        named = registry.funders(refs, options.orgs)
        fields = [c for c in refs.columns if c not in ("doc_id", "i")]
        per_doc = named.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.struct(*fields).alias("f")))), lambda y: y["f"]).alias("named"))
        x = x.join(per_doc, "doc_id", "left").withColumn("funding", F.coalesce("named", "funding")).drop("named")
    return x


def cleaned_text(c: Column | str) -> Column:
    """A document's text as the plan reads it: without marks of captions taken out before, repeats of lines cut."""
    c = F.col(c) if isinstance(c, str) else c
    return lines.collapsed(F.regexp_replace(F.coalesce(c, F.lit("")), _MARKER, ""))


def documents(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """A record for each document (doc_id, text; optional: candidate, the printed title; found_captions, array of kind and text; links; media).

    title, creators, sections, subjects, descriptions, research_field, images, tables, funding, identifiers, related, language, media, title_action,
    n_reclaimed. Repeats of lines are cut. Creators are the structurer's people, grounded in the printed author line; joined names are parted.
    ORCIDs of the text go to creators; other identifiers and links only if asked for. A document whose response cannot be read gets what the text alone gives."""
    optional = {"candidate": "string", "found_captions": "array<struct<kind:string,text:string>>", "links": _NAMES, "media": "string"}
    docs = docs.select("doc_id", cleaned_text("text").alias("text"), *[F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()])
    docs = docs.withColumn("found_captions", F.coalesce("found_captions", _none(optional["found_captions"])))
    x = captions_of(docs.join(parsed(options.structurer(docs.select("doc_id", "text"))), "doc_id", "left"))
    first = F.regexp_extract("text", r"\A\s*(?:#+[ \t]*)?([^\n]*)", 1)
    words = F.transform(F.coalesce(F.col("r.subjects"), _none("array<variant>")), lambda s: F.coalesce(F.try_variant_get(s, "$.subject", "string"), F.when(F.schema_of_variant(s) == "STRING", F.try_variant_get(s, "$", "string"))))
    # A description may be a text, an object, or a list of either.
    of = lambda d: F.struct(F.coalesce(F.try_variant_get(d, "$.description", "string"), F.when(F.schema_of_variant(d) == "STRING", F.try_variant_get(d, "$", "string"))).alias("description"), F.try_variant_get(d, "$.descriptionType", "string").alias("descriptionType"))
    field = text.cleaned(F.col("r.researchField"))
    refs = F.coalesce(records.funding(F.col("r.fundingReferences")), _none(_FUNDING))
    x = x.withColumn("found", identifiers.found(F.col("text"))).withColumns({
        "title": text.spaced(F.coalesce(F.nullif(F.get(F.col("r.titles"), 0)["title"], F.lit("")), first)), "language": language.language(F.col("text")), "model": _split_joined(_model_creators(F.col("v"))), "given_ids": _given_identifiers(F.col("v")),
        "subjects": records.subjects(F.filter(words, lambda s: s.isNotNull() & ~text.is_placeholder(s))),
        "descriptions": records.descriptions(F.transform(F.coalesce(F.try_variant_get("r.descriptions", "$", "array<variant>"), F.when(F.col("r.descriptions").isNotNull(), F.array("r.descriptions")), _none("array<variant>")), of)),
        "research_field": F.when(~F.lower(F.btrim(field)).isin(*fixed.NO_FIELD), field), "own": F.coalesce(F.col("r.content.sections"), _none("array<struct<sectionTitle:string,sectionContent:string>>")),
        "funding": identifiers.typed_funding(identifiers.placed_funders(refs, F.coalesce(F.col("found")["crossref_funder"], _none(_NAMES)), ("awardTitle", "awardNumber", "awardUri"))) if options.extract_identifiers else refs,
        "ids": F.coalesce(identifiers.typed_identifiers(F.col("r.identifiers")), _none(_IDS)), "old": F.coalesce(identifiers.typed_related(F.col("r.relatedIdentifiers")), _none(_RELATED)),
    }).drop("r", "v", "json", "response")
    x = lines.grounded_title(x).withColumns({"title_action": F.when(F.col("candidate").isNull(), "keep").otherwise(F.col("action")), "title": F.when(F.col("candidate").isNull(), F.col("title")).otherwise(F.col("new_title"))}).drop("action", "new_title")
    # Compressed tables, as these hold whole texts twice; the scan of headers reads a title that other Python workers have made.
    x = written(x)
    x = written(people.grounded(x, "model", out="creators") if options.ground_headers else x.withColumn("creators", F.col("model")), instead=x)
    x = _with_registries(x.join(sections_of(x, options), "doc_id", "left"), options)
    own = lambda c: F.flatten(F.transform(F.filter("given_ids", lambda g: g["name"] == c["name"]), lambda g: g["ids"]))
    looked_up = lambda i: F.array_compact(F.array(F.when(F.col("orcids").isNotNull(), F.concat(F.lit("https://orcid.org/"), F.col("orcids")[i]))))
    held = F.transform("creators", lambda c, i: F.when(F.exists(own(c), lambda u: F.contains(u, F.lit("orcid.org/"))), own(c)).otherwise(F.concat(own(c), looked_up(i))))
    orcids = identifiers.placed_orcids(held, F.col("found")["orcid"])

    def affiliation(a: Column) -> Column:
        org = F.when(F.col("orgs").isNotNull(), F.col("orgs")[a])
        return F.struct(a.alias("name"), org["org_id"].alias("affiliationIdentifier"), F.when(org.isNotNull(), "ROR").alias("affiliationIdentifierScheme"), F.when(org.isNotNull(), "https://ror.org/").alias("schemeUri"))

    people_ = F.zip_with("creators", orcids, lambda c, o: F.struct(c["name"].alias("name"), c["given"].alias("givenName"), c["family"].alias("familyName"), people.name_type(c["given"], c["family"]).alias("nameType"), F.transform(c["affiliations"], affiliation).alias("affiliation"), F.transform(o, lambda u: F.struct(u.alias("nameIdentifier"))).alias("nameIdentifiers")))
    ids = identifiers.placed_identifiers(F.col("ids"), F.col("found")["doi"], F.col("found")["arxiv"]) if options.extract_identifiers else _none(_IDS)
    new = identifiers.related_links(F.coalesce("links", _none(_NAMES)), F.transform("old", lambda y: y["relatedIdentifier"]))
    related = F.concat("old", new) if options.extract_identifiers else _none(_RELATED)
    return x.select(
        "doc_id", "title", people_.alias("creators"), F.coalesce("sections", _none("array<struct<sectionTitle:string,sectionContent:string>>")).alias("sections"), "subjects", "descriptions", "research_field",
        "images", "tables", "funding", ids.alias("identifiers"), related.alias("related"), "language", "media", "title_action", F.coalesce("n_reclaimed", F.lit(0)).alias("n_reclaimed"),
    )


def record_texts(made: DataFrame, options: Options = Options()) -> DataFrame:
    """made, of documents(), with json: the record's text, fields in the order below ($schema if the options give its address); report, its validation(), and schema_errors."""
    year, publisher = F.lit(None).cast("int"), F.lit(None).cast("string")
    columns = {"$schema": F.lit(options.schema_address)} if options.schema_address else {}
    columns |= {
        "creators": F.col("creators"), "titles": F.filter(F.array(F.struct("title")), lambda t: t["title"] != ""), "publicationYear": year, "subjects": F.transform("subjects", lambda s: F.struct(s.alias("subject"))), "descriptions": F.col("descriptions"),
        "researchField": F.col("research_field"), "content": F.struct("sections"), "imageCaptions": F.col("images"), "tableCaptions": F.col("tables"), "fundingReferences": F.col("funding"), "language": F.col("language"), "publisher": publisher,
        "formats": F.array_compact(F.array("media")),
    }
    if options.extract_identifiers:
        columns |= {"identifiers": F.col("identifiers"), "relatedIdentifiers": F.col("related")}
    # A null field is written as null; what is null inside a field is left out.
    parts = []
    for i, (k, c) in enumerate(columns.items()):
        made = made.withColumn(f"_json{i}", F.to_json(F.struct(c.alias(k))))
        parts.append(F.when(F.col(f"_json{i}") == "{}", F.lit(f'"{k}":null')).otherwise(F.col(f"_json{i}").substr(F.lit(2), F.length(f"_json{i}") - 2)))
    made = made.withColumn("json", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))).drop(*[f"_json{i}" for i in range(len(parts))])
    return made.withColumns({"report": records.validation(F.col("json")), "schema_errors": records.schema_errors(F.col("json"))})


def with_organisations(records_: DataFrame, orgs: DataFrame) -> DataFrame:
    """doc_id, creator, pos, name, org_id, org_name: affiliations of records with the organisations that they are."""
    flat = records_.select("doc_id", F.posexplode("creators").alias("creator", "c")).select("doc_id", "creator", F.posexplode("c.affiliation.name").alias("pos", "name"))
    return registry.organisations(flat, orgs)

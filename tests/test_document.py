"""The whole plan from a text and a response to a record."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import lines
from lectern.plans import document
from lectern.sources.adapters import Options

RESPONSE = {
    "creators": [
        {"name": "Doe, Jane", "givenName": "Jane", "familyName": "Doe", "affiliation": "Uni", "nameIdentifiers": [{"nameIdentifier": "0000-0001-5109-3700"}]},
        {"name": "A Lee & B Chan", "affiliation": [{"name": "Institute of Boats"}]}, {"name": "Author Name"},
    ],
    "titles": [{"title": "River depth"}], "subjects": ["rivers", {"subject": "Boats"}, "Rivers", "keyword 3"], "descriptions": ["We measured it.", {"description": "Short.", "descriptionType": "Abstract"}],
    "posterContent": {"sections": [{"sectionTitle": "Methods", "sectionContent": "**We measured** the depth of the river twice a day. Figure 1. Depth of river in spring by day"}, {"sectionTitle": "x", "sectionContent": "short"}]},
    "domain": "Other", "conference": {"name": "X"}, "rightsList": ["all rights"], "version": "2", "imageCaptions": [{"caption": "Figure 1. Depth of river in spring by day"}, {"caption": "Figure 2. An invented picture of nothing there"}],
    "fundingReferences": [{"funderName": "NSF", "awardNumber": " ab-1. "}],
}
TEXT = """# River depth
Jane Doe1, A Lee2
1 University of Alder, 2 Institute of Boats
[Figure caption 1 extracted]

## Methods
We measured the depth of the river twice a day.
Figure 1. Depth of river in spring by day

## Results
Water rose by seven metres and the village moved its boats up to the old road in April.

The nets were dry all summer long.

## Discussion
ORCID 0000-0002-1825-0097 doi:10.1234/abc 10.13039/100000005"""
DOCS = "doc_id long, text string, candidate string, found_captions array<struct<kind:string,text:string>>, links array<string>, media string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT, "River depth in spring", [("figure", "Figure 1. Depth of river in spring by day")], ["https://example.org/data", "mailto:x"], "application/pdf"), (2, None, None, None, None, None), (3, "Only a plain text line of some length here\nand a second one", None, None, None, None)], DOCS)


def answers(docs):
    return docs.select("doc_id", F.when(F.col("doc_id") == 1, F.lit(json.dumps(RESPONSE))).otherwise(F.lit("no json")).alias("response"))


def written(docs, **options):
    options = Options(structurer=answers, **options)
    return {r.doc_id: (json.loads(r.json), r.report, r) for r in document.record_texts(document.documents(docs, options), options).collect()}


def test_record(docs):
    got = written(docs, schema_address="https://example.org/schema.json")
    record, report, row = got[1]
    assert list(record) == ["$schema", "creators", "titles", "publicationYear", "subjects", "descriptions", "researchField", "content", "imageCaptions", "tableCaptions", "fundingReferences", "language", "publisher", "formats"]
    assert [(c["name"], c["nameType"], [a["name"] for a in c["affiliation"]]) for c in record["creators"]] == [("Doe, Jane", "Personal", ["University of Alder"]), ("A Lee", "Organizational", ["Institute of Boats"]), ("B Chan", "Organizational", ["Institute of Boats"])]
    assert record["creators"][0]["nameIdentifiers"] == [{"nameIdentifier": "https://orcid.org/0000-0001-5109-3700"}, {"nameIdentifier": "https://orcid.org/0000-0002-1825-0097"}]
    assert record["titles"] == [{"title": "River depth in spring"}] and row.title_action == "extend"
    assert record["subjects"] == [{"subject": "rivers"}, {"subject": "Boats"}] and record["researchField"] is None and record["publisher"] is None and record["publicationYear"] is None
    assert record["descriptions"] == [{"description": "We measured it.", "descriptionType": "Other"}, {"description": "Short.", "descriptionType": "Abstract"}]
    sections = record["content"]["sections"]
    assert sections[0] == {"sectionTitle": "Methods", "sectionContent": "We measured the depth of the river twice a day."}
    assert sections[1] == {"sectionTitle": "Results", "sectionContent": "Water rose by seven metres and the village moved its boats up to the old road in April.\nThe nets were dry all summer long."}
    assert row.n_reclaimed == len(sections) - 1
    assert record["imageCaptions"] == [{"id": "fig1", "caption": "Figure 1. Depth of river in spring by day"}] and record["tableCaptions"] == []
    assert record["fundingReferences"] == [{"funderName": "NSF", "awardNumber": "AB-1"}] and record["formats"] == ["application/pdf"]
    assert report.valid and report.field_issues[0] == "Missing required fields: conference"


def test_record_without_response(docs):
    got = written(docs)
    assert got[2][0]["creators"] == [] and got[2][0]["titles"] == [] and got[2][0]["content"] == {"sections": []}
    assert got[3][0]["content"]["sections"] == [{"sectionContent": "Only a plain text line of some length here\nand a second one"}] and got[3][2].title_action == "keep"


def test_record_with_registries(spark, docs):
    orgs = spark.createDataFrame([("https://ror.org/1", "University of Alder", ["UA"], ["funder"], None), ("https://ror.org/2", "NSF", [], ["funder"], "100000001")], "org_id string, display_name string, names array<string>, types array<string>, fundref string")
    persons = spark.createDataFrame([("0000-0001-0000-0001", "Jane", "Doe", ["University of Alder"])], "orcid string, given string, family string, orgs array<string>")
    record, _, row = written(docs, orgs=orgs, persons=persons, extract_identifiers=True)[1]
    assert record["creators"][0]["affiliation"] == [{"name": "University of Alder", "affiliationIdentifier": "https://ror.org/1", "affiliationIdentifierScheme": "ROR", "schemeUri": "https://ror.org/"}]
    assert record["fundingReferences"][0]["funderIdentifier"] == "https://doi.org/10.13039/100000005" and record["fundingReferences"][0]["funderIdentifierType"] == "Crossref Funder ID"
    assert {"identifier": "10.1234/abc", "identifierType": "DOI"} in record["identifiers"]
    assert record["relatedIdentifiers"] == [{"relatedIdentifier": "https://example.org/data", "relatedIdentifierType": "URL", "relationType": "References"}]


def test_person_lookup_fills_in_only_where_none_is_given(spark, docs):
    persons = spark.createDataFrame([("0000-0001-0000-0001", "Jane", "Doe", ["University of Alder"])], "orcid string, given string, family string, orgs array<string>")
    plain = docs.withColumn("text", F.regexp_replace("text", "ORCID 0000-0002-1825-0097", ""))
    response = json.dumps(dict(RESPONSE, creators=[{"name": "Doe, Jane", "givenName": "Jane", "familyName": "Doe"}]))
    options = Options(structurer=lambda d: d.select("doc_id", F.lit(response).alias("response")), persons=persons)
    row = document.documents(plain, options).where("doc_id = 1").first()
    assert [[i.nameIdentifier for i in c.nameIdentifiers] for c in row.creators][0] == ["https://orcid.org/0000-0001-0000-0001"]


def test_reclaimed_runs(spark):
    rows = [(0, "## Intro", True, None), (1, "held line", False, False), (2, "## Found", True, None), (3, "a free line here", False, True), (4, "", False, None), (5, "and one more", False, True), (6, "Methods", False, True), (7, "tiny", False, True), (8, "held", False, False), (9, "no header above this", False, True), (10, "## Only a header", True, None)]
    marked = spark.createDataFrame([(1, p, t, h) for p, t, h, _ in rows], "doc_id long, pos int, line string, header boolean")
    free = spark.createDataFrame([(1, p, u) for p, _, _, u in rows if u is not None], "doc_id long, pos int, uncaptured boolean")
    got = sorted((r.title, r.content) for r in lines.reclaimed(marked, free).collect() if r.title)
    assert got == [("Found", "a free line here\nand one more")]
    assert sorted(r.content for r in lines.reclaimed(marked, free).collect() if not r.title) == ["no header above this"]


def test_no_token_of_a_line_is_shuffled(spark):
    """Lines and captured texts meet by document: what is dealt out are texts, not words or n-grams."""
    docs = spark.createDataFrame([(i, "\n".join(f"the river {i} rose by {j} feet in the night of spring" for j in range(20))) for i in range(40)], "doc_id long, text string")
    rows = lines.lines_of(docs)
    found = lines.uncaptured(rows, rows.where("pos % 2 = 0").select("doc_id", F.col("line").alias("text")), rows.where("pos = 1").select("doc_id", F.col("line").alias("text")))
    assert found.count() == 800 and found.where("uncaptured").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning(doc_id") == 1 and "Join" not in plan


def test_counts_of_lines():
    got = lines.counts([["a", "b", "c", "a", "b", "c"], ["7", "x"], []], [["a", "b", "c"], ["b", "a"]], [["x"]], 3)
    assert got == [(6, 6, 0, 4, 2), (2, 0, 2, 0, 0), (0, 0, 0, 0, 0)]


def test_middle_tables_are_compressed_and_given_up(spark, tmp_path):
    """A table that takes another's place deletes it; one that was not written by the plan stays."""
    from pathlib import Path

    from lectern.session import checkpoint_folder, written

    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    tables = lambda: {x.name for x in folder.glob("lectern-*")}
    before = tables()
    first = written(spark.range(10).selectExpr("id", "repeat('river ', 1000) AS t"))
    (name,) = tables() - before
    second = written(first.selectExpr("id + 1 AS id", "t"), instead=first)
    assert name not in tables() and len(tables() - before) == 1 and second.count() == 10
    spark.range(3).write.parquet(str(tmp_path / "given"))
    given = spark.read.parquet(str(tmp_path / "given"))
    assert written(given, instead=given).count() == 3 == spark.read.parquet(str(tmp_path / "given")).count()

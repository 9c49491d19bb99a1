"""Queries over people, registries, records, layout and whole plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed, text
from lectern.operators import copying, layout, pages, people, records, registry, schema, stream
from lectern.session import dealt, written
from lectern.sources import files
from lectern.sources.adapters import Options

from . import document, inputs

# --- people and registries ----------------------------------------------------------------------------------------------------

AFFILIATION = "CASE c_custkey % 5 WHEN 0 THEN concat('University of ', n_name) WHEN 1 THEN concat('University of ', n_name, ', La Jolla, CA') WHEN 2 THEN concat('Department of Physics, University of ', n_name) WHEN 3 THEN concat('university of ', lower(n_name), ', Germany') ELSE concat('University of ', n_name, ', School of Medicine') END"


def organisations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "nation").selectExpr("concat('https://ror.org/0abcdef', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS org_id", "concat('University of ', n_name) AS display_name", "array(n_name) AS names", "CASE WHEN n_nationkey % 2 = 0 THEN array('education', 'funder') ELSE array('education') END AS types", "CASE WHEN n_nationkey % 4 = 0 THEN CAST(100000000 + n_nationkey AS STRING) END AS fundref")


def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.table(spark, sf_dir, "customer").join(F.broadcast(inputs.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey", f"{AFFILIATION} AS name")
    return registry.organisations(c, organisations_of(spark, sf_dir)).select("c_custkey", "name", "org_id", "org_name")


ORGANISATIONS = rf"""
    WITH a AS (SELECT c_custkey, {AFFILIATION} AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    o AS (SELECT concat('https://ror.org/0abcdef', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS org_id, concat('University of ', n_name) AS org_name, unnest([lower(concat('University of ', n_name)), lower(n_name)]) AS n FROM nation),
    h AS (SELECT DISTINCT a.name, o.org_id, o.org_name, o.n, regexp_replace(substr(lower(a.name), length(o.n) + 1), '^[ ,.;]+', '') AS tail FROM (SELECT DISTINCT name FROM a) a JOIN o ON lower(a.name) = o.n OR starts_with(lower(a.name), concat(o.n, ','))),
    k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY length(n) DESC, org_id) AS i FROM h
        WHERE tail = '' OR (NOT regexp_matches(tail, '(?i)univers|institut|depart|division|school|colleg|hospital|clinic|laborator|center|centre|facult|academ|foundation|research') AND len(string_split(tail, ',')) <= 4 AND length(tail) <= 30))
    SELECT c_custkey, a.name, k.org_id, k.org_name FROM a LEFT JOIN k ON a.name = k.name AND k.i = 1"""


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons; one in seven is in the registry twice, one in five works elsewhere."""
    c = inputs.table(spark, sf_dir, "customer")
    asked = c.selectExpr("c_custkey AS creator_id", "concat('Ána ', CAST(c_custkey AS STRING)) AS given", "c_mktsegment AS family", "CASE WHEN c_custkey % 11 = 0 THEN array() ELSE array(concat('Org ', CAST(c_nationkey AS STRING)), 'Other') END AS affiliations")
    known = c.selectExpr("concat('0000-', CAST(c_custkey AS STRING)) AS orcid", "concat('ana ', CAST(c_custkey AS STRING)) AS given", "lower(c_mktsegment) AS family", "array(CASE WHEN c_custkey % 5 = 0 THEN 'elsewhere' ELSE concat('org ', CAST(c_nationkey AS STRING)) END) AS orgs")
    twice = known.where("CAST(substr(orcid, 6) AS INT) % 7 = 0").withColumn("orcid", F.concat("orcid", F.lit("X")))
    return registry.persons(asked, known.unionByName(twice)).select("creator_id", "orcid")


PERSONS = "SELECT c_custkey AS creator_id, CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN concat('0000-', c_custkey) END AS orcid FROM customer"


def funders(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = inputs.table(spark, sf_dir, "supplier").join(F.broadcast(inputs.table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey", "concat('  UNIVERSITY of ', n_name) AS funderName", "CASE WHEN s_suppkey % 6 = 0 THEN 'own' END AS funderIdentifier", "CAST(NULL AS STRING) AS funderIdentifierType", "CAST(NULL AS STRING) AS schemeUri")
    return registry.funders(refs, organisations_of(spark, sf_dir)).select("s_suppkey", "funderName", "funderIdentifier", "funderIdentifierType", "schemeUri")


FUNDERS = """
    WITH s AS (SELECT s_suppkey, n_nationkey AS k, n_name, s_suppkey % 6 <> 0 AND n_nationkey % 2 = 0 AS hit FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT s_suppkey, CASE WHEN hit THEN concat('University of ', n_name) ELSE concat('  UNIVERSITY of ', n_name) END AS funderName,
        CASE WHEN hit AND k % 4 = 0 THEN concat('https://doi.org/10.13039/', 100000000 + k) WHEN hit THEN concat('https://ror.org/0abcdef', lpad(k::VARCHAR, 2, '0')) WHEN s_suppkey % 6 = 0 THEN 'own' END AS funderIdentifier,
        CASE WHEN hit AND k % 4 = 0 THEN 'Crossref Funder ID' WHEN hit THEN 'ROR' END AS funderIdentifierType,
        CASE WHEN hit AND k % 4 = 0 THEN 'https://doi.org/10.13039' WHEN hit THEN 'https://ror.org' END AS schemeUri FROM s"""


#: The first words of a text stand for an organisation's name; every third is asked for in another order, every fifth with one word changed, others as the whole first line.
FIRST = "slice(regexp_extract_all(lower(translate(coalesce(text, ''), chr(10), ' ')), '[a-z0-9]+', 0), 1, 30)"


def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all documents against a registry of the names of those with even ids, by shared weight of tokens or as phrases."""
    docs = written(inputs.documents(spark, sf_dir, f"{FIRST} AS w")).where("size(w) > 0")
    orgs = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("o"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("org_id"), F.array_join(F.slice("w", 1, 6), " ").alias("display_name"), F.array().cast("array<string>").alias("names"))
    changed = F.concat(F.array(F.lit("the")), F.slice("w", 1, 6))
    asked = docs.select("doc_id", F.array_join(F.when(F.col("doc_id") % 3 == 0, F.reverse(F.slice("w", 1, 6))).when(F.col("doc_id") % 5 == 0, changed).otherwise(F.col("w")), " ").alias("name"))
    return asked.join(registry.matches(asked, orgs), "name", "left").select("doc_id", "org_id", F.round("score", 6).alias("score"), "phrase")


NAME_MATCHES = """
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(translate(coalesce(text, ''), chr(10), ' ')), '[a-z0-9]+')[1:30] AS w FROM documents),
    o AS (SELECT 'o' || lpad(doc_id::VARCHAR, 9, '0') AS org_id, w[1:6] AS w, list_distinct(w[1:6]) AS t FROM d WHERE doc_id % 2 = 0 AND len(w) > 0),
    f AS (SELECT token, floor(1000 * ln(1 + (SELECT count(*) FROM o)::DOUBLE / count(*)))::BIGINT AS x FROM (SELECT unnest(t) AS token FROM o) GROUP BY token),
    ow AS (SELECT org_id, sum(x) AS total FROM (SELECT org_id, unnest(t) AS token FROM o) JOIN f USING (token) GROUP BY org_id),
    q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN list_reverse(w[1:6]) WHEN doc_id % 5 = 0 THEN list_prepend('the', w[1:6]) ELSE w END AS w FROM d WHERE len(w) > 0),
    qt AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(w) AS token FROM q)),
    qw AS (SELECT doc_id, sum(coalesce(x, floor(1000 * ln(1 + (SELECT count(*) FROM o)::DOUBLE))::BIGINT)) AS total FROM qt LEFT JOIN f USING (token) GROUP BY doc_id),
    p AS (SELECT qt.doc_id, s.org_id, sum(f.x) AS shared FROM qt JOIN (SELECT org_id, unnest(t) AS token FROM o) AS s USING (token) JOIN f USING (token) GROUP BY ALL),
    r AS (
        SELECT p.doc_id, p.org_id, shared, qw.total + ow.total - shared AS whole, contains(' ' || array_to_string(q.w, ' ') || ' ', ' ' || array_to_string(o.w, ' ') || ' ') AS phrase, length(array_to_string(o.w, ' ')) AS long
        FROM p JOIN qw USING (doc_id) JOIN ow USING (org_id) JOIN q USING (doc_id) JOIN o USING (org_id)
    ), b AS (
        SELECT doc_id, org_id, round(shared / whole::DOUBLE, 6) AS score, phrase FROM r WHERE phrase OR shared * 100 >= 95 * whole
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY phrase DESC, CASE WHEN phrase THEN long END DESC NULLS LAST, shared / whole::DOUBLE DESC, org_id) = 1
    )
    SELECT q.doc_id, b.org_id, b.score, b.phrase FROM q LEFT JOIN b USING (doc_id)"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, f"{inputs.HEAD} AS text", "concat('Depth of the River ', CAST(doc_id AS STRING)) AS title")
    h = people.headers(docs)
    names = F.array_join(F.transform("h.authors", lambda a: F.concat(a["name"], F.lit(" @ "), F.array_join(F.coalesce(a["affiliations"], F.array().cast("array<string>")), " / "))), "; ")
    return h.select("doc_id", names.alias("authors"), F.cardinality("h.entries").alias("n_entries"), "h.confident", "h.reason")


HEADERS = """
    WITH d AS (SELECT doc_id, doc_id % 4 = 0 AS three, doc_id % 8 = 0 AS listed FROM documents)
    SELECT doc_id, CASE WHEN three AND NOT listed THEN 'Doe, Jane Q. @ ; van Dam, Max @ ; Lima, Ana @ ' ELSE concat('Doe, Jane Q. @ University of Alder, Alder; van Dam, Max @ University of Alder, Alder / Institute of Boats, Birch', CASE WHEN three THEN '; Lima, Ana @ Hospital of Cedar' ELSE '' END) END AS authors,
        CASE WHEN listed THEN 3 ELSE 2 END AS n_entries, NOT (three AND NOT listed) AS confident, CASE WHEN three AND NOT listed THEN 'no entry for mark 3' ELSE 'marks and list agree' END AS reason FROM d"""


def creators_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, f"{inputs.HEAD} AS text", "concat('Depth of the River ', CAST(doc_id AS STRING)) AS title", "array(named_struct('given', 'M.', 'family', 'van Dam', 'name', 'van Dam, M.', 'affiliations', array('Institute of Boats')), named_struct('given', 'Jane', 'family', 'Doe', 'name', 'Doe, Jane PhD', 'affiliations', array('University of Alder'))) AS model")
    g = people.grounded(docs, "model").withColumnRenamed("grounded", "c")
    return g.select("doc_id", F.to_json("c").alias("creators"))


GROUNDED = """
    SELECT doc_id, CASE WHEN doc_id % 8 = 4 THEN '[{"given":"M.","family":"van Dam","name":"van Dam, M.","affiliations":["Institute of Boats, Birch"]},{"given":"Jane","family":"Doe","name":"Doe, Jane PhD","affiliations":["University of Alder, Alder"]}]'
        ELSE concat('[{"given":"Jane Q.","family":"Doe","name":"Doe, Jane Q.","affiliations":["University of Alder, Alder"]},{"given":"M.","family":"van Dam","name":"van Dam, M.","affiliations":["University of Alder, Alder","Institute of Boats, Birch"]}',
            CASE WHEN doc_id % 8 = 0 THEN ',{"given":"Ana","family":"Lima","name":"Lima, Ana","affiliations":["Hospital of Cedar"]}' ELSE '' END, ']') END AS creators FROM documents"""


def numbered_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "concat('## Rivers', chr(10), 'Jane Doe¹, Max Roe¹,²', CASE WHEN doc_id % 3 = 0 THEN ', Ana Lima' ELSE '' END, chr(10), '1 University of Alder; 2 Institute of Birch', chr(10), '## Abstract', chr(10), text) AS text", "CASE WHEN doc_id % 3 = 0 THEN array('Doe', 'Roe', 'Lima') ELSE array('Doe', 'Roe') END AS families")
    x = docs.select("doc_id", people.numbered_affiliations("families", "text").alias("a"))
    return x.select("doc_id", F.array_join(F.transform("a", lambda p: F.array_join(p, " / ")), "; ").alias("affiliations"))


NUMBERED = "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'University of Alder; University of Alder / Institute of Birch' END AS affiliations FROM documents"


#: The first words of four letters or more of a text, as names.
NAMES = "transform(slice(filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+', 0), w -> length(w) >= 4), 1, 6), w -> concat(upper(substr(w, 1, 1)), substr(w, 2)))"


def joined_creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of a text's words, joined in three ways or not at all."""
    name = "CASE doc_id % 4 WHEN 0 THEN concat(n[0], ', ', n[1], ' & ', n[2], ', ', n[3]) WHEN 1 THEN concat(n[0], ' ', n[1], ' and ', n[2], ' ', n[3]) WHEN 2 THEN concat('Institute of ', n[0], ' and ', n[1]) ELSE concat(n[0], ' ', n[1]) END AS name"
    docs = inputs.documents(spark, sf_dir, f"{NAMES} AS n").where("size(n) = 6").selectExpr("doc_id", name)
    return docs.select("doc_id", F.posexplode(people.split_joined(F.col("name"))).alias("pos", "name")).select("doc_id", F.col("pos").cast("long").alias("pos"), "name")


JOINED = """
    WITH n AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: length(w) >= 4)[1:6], lambda w: upper(w[1]) || w[2:]) AS n FROM documents),
    j AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN [n[1] || ', ' || n[2], n[3] || ', ' || n[4]] WHEN 1 THEN [n[1] || ' ' || n[2], n[3] || ' ' || n[4]] WHEN 2 THEN ['Institute of ' || n[1] || ' and ' || n[2]] ELSE [n[1] || ' ' || n[2]] END AS n FROM n WHERE len(n) = 6)
    SELECT doc_id, (generate_subscripts(n, 1) - 1)::BIGINT AS pos, unnest(n) AS name FROM j"""


def marker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "concat('¹', CAST(doc_id % 9 AS STRING), '-', CAST(doc_id % 9 + doc_id % 4 AS STRING), ',30-60') AS m", "CASE WHEN doc_id % 2 = 0 THEN 'Lastname, FirstName' ELSE 'Doe, Jane' END AS name")
    return docs.select("doc_id", F.array_join(text.markers("m"), " ").alias("marks"), text.is_placeholder_person(F.col("name"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("placeholder"))


MARKS = "SELECT doc_id, concat('1', doc_id % 9, ' ', doc_id % 9 + doc_id % 4, ' 30 60') AS marks, doc_id % 2 = 0 AS placeholder FROM documents"


# --- records ------------------------------------------------------------------------------------------------------------------------

#: A whole text as an answer, damaged in five ways: fenced, with quotes inside a title and talk around it, without its last brackets, with commas before brackets, cut off within the text.
ANSWERED = "to_json(named_struct('titles', array(named_struct('title', title)), 'content', named_struct('sections', array(named_struct('sectionTitle', 'All', 'sectionContent', concat(text, ' the end of it'))))))"
DAMAGED = """CASE doc_id % 6 WHEN 0 THEN concat('```json', chr(10), a, chr(10), '```') WHEN 1 THEN concat('Here it is: ', replace(a, '{"title":"', '{"title":"The "deep" '), ' Hope this helps {x}')
    WHEN 2 THEN substr(a, 1, length(a) - 2) WHEN 3 THEN concat(substr(a, 1, length(a) - 3), ',]', '},}') WHEN 4 THEN substr(a, 1, length(a) - 6) ELSE a END AS response"""


def json_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "coalesce(text, '') AS text", "split(coalesce(text, ''), chr(10))[0] AS title").selectExpr("doc_id", f"{ANSWERED} AS a").selectExpr("doc_id", DAMAGED)
    x = docs.withColumn("v", F.try_parse_json(records.repaired_json("response")))
    return x.select("doc_id", F.try_variant_get("v", "$.titles[0].title", "string").alias("title"), F.try_variant_get("v", "$.content.sections[0].sectionContent", "string").alias("content"))


REPAIRS = """SELECT doc_id, concat(CASE doc_id % 6 WHEN 1 THEN 'The "deep" ' ELSE '' END, string_split(coalesce(text, ''), chr(10))[1]) AS title, concat(coalesce(text, ''), CASE doc_id % 6 WHEN 4 THEN ' the end of i' ELSE ' the end of it' END) AS content FROM documents"""

#: The lines of a text, each then again in capitals and blanks.
TWICE = "concat(split(coalesce(text, ''), chr(10)), transform(split(coalesce(text, ''), chr(10)), l -> concat('  ', translate(l, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ')))"
SQL_TWICE = "list_concat(string_split(coalesce(text, ''), chr(10)), list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: '  ' || translate(l, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' '))"


def captions_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of a text as captions, every third with an id; then all again in capitals."""
    docs = inputs.documents(spark, sf_dir, f"to_json(transform({TWICE}, (l, i) -> named_struct('id', CASE WHEN i % 3 = 0 THEN concat('own', i) END, 'caption', l))) AS j")
    found = docs.select("doc_id", records.captions(F.try_parse_json("j"), "fig").alias("c"))
    return found.select("doc_id", F.posexplode("c").alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), "x.id", "x.caption")


CAPTION_ROWS = f"""
    WITH l AS (SELECT doc_id, unnest(l) AS l, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, {SQL_TWICE} AS l FROM documents)),
    f AS (SELECT doc_id, i, trim(l) AS caption FROM l WHERE trim(l) <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, substr(lower(trim(l)), 1, 100) ORDER BY i) = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f)
    SELECT doc_id, k - 1 AS pos, CASE WHEN i % 3 = 0 THEN concat('own', i) ELSE concat('fig', k) END AS id, caption FROM n"""


def affiliations_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's first line, all its lines as strings and objects in turn, or the whole text in an object."""
    quoted = "transform(split(coalesce(text, ''), chr(10)), (l, i) -> CASE WHEN i % 2 = 0 THEN substr(to_json(array(l)), 2, length(to_json(array(l))) - 2) ELSE to_json(named_struct('name', l, 'affiliationIdentifier', 'made up')) END)"
    value = f"CASE doc_id % 3 WHEN 0 THEN ({quoted})[0] WHEN 1 THEN concat('[', array_join({quoted}, ','), ']') ELSE to_json(named_struct('name', coalesce(text, ''))) END"
    docs = inputs.documents(spark, sf_dir, f"try_parse_json({value}) AS v")
    return docs.select("doc_id", F.array_join(F.transform(records.affiliations(F.col("v")), lambda a: a["name"]), "; ").alias("names"))


AFFILIATIONS = """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN trim(string_split(coalesce(text, ''), chr(10))[1])
        WHEN 1 THEN array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l)), lambda l: l <> ''), '; ') ELSE trim(coalesce(text, '')) END AS names FROM documents"""


def funding_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a text as a funder, with an award of its length."""
    refs = "transform(split(coalesce(text, ''), chr(10)), (l, i) -> named_struct('funderName', concat('  ', replace(l, ' ', '   ')), 'funderIdentifier', 'https://ror.org/03yrm5c26', 'funderIdentifierType', CASE WHEN i % 2 = 0 THEN 'ROR' ELSE 'Other' END, 'schemeUri', CAST(NULL AS STRING), 'awardTitle', CAST(NULL AS STRING), 'awardNumber', concat('( ab-', length(l), '. )'), 'awardUri', CASE WHEN i % 3 = 0 THEN 'https://x.org' ELSE 'none' END)) AS refs"
    docs = inputs.documents(spark, sf_dir, refs).select("doc_id", F.posexplode(records.funding(F.col("refs"))).alias("pos", "r"))
    return docs.select("doc_id", F.col("pos").cast("long").alias("pos"), "r.funderName", "r.schemeUri", "r.awardNumber", "r.awardUri")


FUNDING = r"""
    WITH l AS (SELECT doc_id, unnest(l) AS l, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
    SELECT doc_id, pos::BIGINT AS pos, trim(regexp_replace(l, '\s+', ' ', 'g')) AS funderName, CASE WHEN pos % 2 = 0 THEN 'https://ror.org' END AS schemeUri, concat('AB-', length(l)) AS awardNumber, CASE WHEN pos % 3 = 0 THEN 'https://x.org' END AS awardUri FROM l"""


def subjects_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, f"{TWICE} AS s")
    return docs.select("doc_id", F.array_join(records.subjects(F.col("s")), "; ").alias("subjects"))


SUBJECTS = rf"""
    WITH l AS (SELECT doc_id, unnest(l) AS l, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {SQL_TWICE} AS l FROM documents)),
    f AS (SELECT doc_id, i, trim(regexp_replace(l, '\s+', ' ', 'g')) AS l FROM l),
    k AS (SELECT * FROM f WHERE l <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(l) ORDER BY i) = 1)
    SELECT d.doc_id, coalesce((SELECT string_agg(l, '; ' ORDER BY i) FROM k WHERE k.doc_id = d.doc_id), '') AS subjects FROM documents AS d"""


def sections_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a text as a section, every third with a title, then all again in capitals with titles; labels between them."""
    # The number of lines is found before they are dealt out: beside posexplode() it would be found again, from the whole text, for each line.
    made = inputs.documents(spark, sf_dir, f"concat({TWICE}, array('Author Names and Affiliations:', 'Poster Title', 'Materials and Methods')) AS l", "size(split(coalesce(text, ''), chr(10))) AS n")
    rows = made.select("doc_id", F.posexplode("l").alias("pos", "content"), "n")
    titled = rows.select("doc_id", "pos", F.when((F.col("pos") % 3 == 1) | (F.col("pos") >= F.col("n")), F.concat(F.lit("T"), "pos")).alias("title"), "content")
    return records.sections(titled).select("doc_id", F.col("pos").cast("long").alias("pos"), "title", "content")


def _quoted_list(values: object) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


KEPT = rf"""
    WITH l AS (SELECT doc_id, n, unnest(l) AS l, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, list_concat({SQL_TWICE}, ['Author Names and Affiliations:', 'Poster Title', 'Materials and Methods']) AS l, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)),
    c AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 1 OR pos >= n THEN 'T' || pos END AS title, trim(l, ' ' || chr(9) || chr(10) || chr(13)) AS content FROM l),
    g AS (SELECT *, list_filter(regexp_split_to_array(lower(trim(regexp_replace(content, '[#*•:/\\\-–—]', ' ', 'g'))), '\s+'), lambda x: x <> '') AS tw, lower(trim(regexp_replace(content, '[#*•:/\\\-–—]', ' ', 'g'))) AS t FROM c WHERE length(content) > 10),
    k AS (
        SELECT doc_id, pos, title, content, lower(trim(regexp_replace(content, '\s+', ' ', 'g'))) AS k FROM g
        WHERE NOT (length(content) <= 60 AND regexp_matches(content, '^[A-Za-z][A-Za-z0-9&,''()/\- ]{{0,58}}:$')) AND NOT (length(t) <= 45 AND len(tw) > 0 AND len(list_filter(tw, lambda x: x NOT IN {_quoted_list(fixed.SECTION_LABELS)})) = 0)
            AND NOT (trim(regexp_replace(lower(content), '[.…]+$', '')) IN {_quoted_list(fixed.PLACEHOLDERS)} OR regexp_matches(trim(regexp_replace(lower(content), '[.…]+$', '')), '^keyword\s*\d*$'))
    )
    SELECT doc_id, (min(pos) OVER (PARTITION BY doc_id, k))::BIGINT AS pos, title, content FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY title IS NULL, pos) = 1"""

#: A record whose creators, titles and sections are the lines of a text; every tenth text is cut off.
RECORD = (
    "to_json(named_struct('creators', transform(l, (x, i) -> CASE WHEN i % 4 = 3 THEN named_struct('given', x) ELSE named_struct('name', x) END), 'titles', transform(l, x -> named_struct('title', slice(split(x, ' '), 1, 1)[0])), "
    "'content', named_struct('sections', transform(l, (x, i) -> CASE WHEN i % 2 = 0 THEN named_struct('sectionTitle', 'M', 'sectionContent', x) ELSE named_struct('sectionTitle', 'M', 'sectionContent', CAST(NULL AS STRING)) END)), 'imageCaptions', transform(l, (x, i) -> named_struct('caption', CASE WHEN i % 3 > 0 THEN x END))))"
)
# Structs of one array have one type: fields that a line does not have are null, and are not written.
RECORD = RECORD.replace("named_struct('given', x) ELSE named_struct('name', x)", "named_struct('name', CAST(NULL AS STRING), 'given', x) ELSE named_struct('name', x, 'given', CAST(NULL AS STRING))")


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "split(coalesce(text, ''), chr(10)) AS l").selectExpr("doc_id", f"{RECORD} AS record")
    cut = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 9, F.expr("substr(record, 1, length(record) - 1)")).otherwise(F.col("record")).alias("record"))
    x = cut.select("doc_id", records.validation(F.col("record")).alias("v"))
    return x.select("doc_id", "v.valid", F.array_join("v.field_issues", " | ").alias("issues"), F.array_join("v.warnings", " | ").alias("warnings"))


VALIDATIONS = """
    WITH d AS (SELECT doc_id, doc_id % 10 <> 9 AS valid, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    i AS (
        SELECT doc_id, valid, list_transform(l, lambda x, i: CASE WHEN i % 4 = 0 THEN 'creators[' || (i - 1) || '] missing required ''name'' field' WHEN NOT contains(x, ',') THEN 'creators[' || (i - 1) || '].name should be in ''Family, Given'' format: ''' || x || '''' END) AS c,
            list_transform(l, lambda x, i: CASE WHEN length(trim(string_split(x, ' ')[1])) < 5 THEN 'titles[' || (i - 1) || '].title appears too short: ''' || string_split(x, ' ')[1] || '''' END) AS t,
            list_transform(l, lambda x, i: CASE WHEN i % 2 = 0 THEN 'content.sections[' || (i - 1) || '] missing ''sectionContent''' END) AS s,
            list_transform(l, lambda x, i: CASE WHEN i % 3 = 1 THEN 'imageCaptions[' || (i - 1) || '] missing required ''caption'' field' END) AS w FROM d
    )
    SELECT doc_id, valid, CASE WHEN valid THEN array_to_string(list_prepend('Missing required fields: publicationYear, subjects, descriptions, conference, formats', list_filter(list_concat(c, t, s), lambda x: x IS NOT NULL)), ' | ')
            ELSE 'Missing required fields: creators, titles, publicationYear, subjects, descriptions, conference, formats' END AS issues,
        CASE WHEN valid THEN array_to_string(list_filter(w, lambda x: x IS NOT NULL), ' | ') ELSE 'content is missing - no sections extracted' END AS warnings FROM i"""


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "concat('/in/', coalesce(text, ''), CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.txt' ELSE '' END) AS path")
    return docs.select("doc_id", files.file_kind(F.col("path")).alias("kind"), files.media_type(F.col("path")).alias("media"), files.is_supported(F.col("path")).alias("supported"))


KINDS = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'image' END AS kind, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' END AS media, doc_id % 5 < 3 AS supported FROM documents"


def text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'image' END AS kind", "text AS layout_text", "concat(text, ' plain') AS plain_text", "'seen' AS ocr_text", "CASE WHEN doc_id % 3 = 0 THEN text END AS cached_text")
    return files.raw_text(docs).select("doc_id", "text_source", F.length("text").cast("long").alias("n_chars"))


SOURCES = """
    WITH s AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 AND length(text) BETWEEN 200 AND 30000 THEN 'layout' WHEN doc_id % 2 = 0 AND length(text) + 6 >= 200 THEN 'plain' WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 AND length(text) > 500 THEN 'cached' ELSE 'ocr' END AS text_source FROM documents)
    SELECT doc_id, text_source, (CASE text_source WHEN 'layout' THEN length(text) WHEN 'plain' THEN length(text) + 6 WHEN 'cached' THEN length(text) ELSE 4 END)::BIGINT AS n_chars FROM s"""

#: Pages of twenty documents each: they grow in number with the table.
PAGE_OF = "CAST(floor(doc_id / 20) AS BIGINT)"

# --- layout ---------------------------------------------------------------------------------------------------------------------------

GLYPHS = "SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber AS si, l_quantity * 10 AS x0, l_quantity * 10 + 6 AS x1, (l_partkey % 4) * 20.0::DOUBLE AS top, (l_partkey % 4) * 20.0::DOUBLE + 10 AS bottom, CASE WHEN l_suppkey % 3 = 0 THEN 12.0::DOUBLE ELSE 10.0::DOUBLE END AS size, CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE 'x' END AS text FROM lineitem"


def mode_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.mode_size(inputs.glyphs(spark, sf_dir), ("doc_id",))


MODES = f"WITH g AS ({GLYPHS}), c AS (SELECT doc_id, round(size * 2) / 2 AS s, count(*) AS n FROM g GROUP BY 1, 2) SELECT doc_id, arg_max(s, n * 1000 + s) AS mode_size FROM c GROUP BY doc_id"


def glyph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.glyph_stats(inputs.glyphs(spark, sf_dir), ("doc_id",)).select("doc_id", "x0", "top", "x1", "bottom", F.round("mean_size", 6).alias("mean_size"), "min_size", "median_size", F.round("x_tol", 6).alias("x_tol"))


STATS = f"""
    WITH g AS ({GLYPHS}), a AS (SELECT doc_id, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, round(avg(size), 6) AS mean_size, min(size) AS min_size, median(size) FILTER (text <> ' ') AS median_size, median(x1 - x0) FILTER (text = ' ') AS blank FROM g GROUP BY doc_id)
    SELECT doc_id, x0, top, x1, bottom, mean_size, min_size, median_size, round(CASE WHEN blank IS NULL THEN greatest(1.5, least(3.0, median_size * 0.25)) ELSE least(greatest(1.5, least(3.0, median_size * 0.25)), blank * 0.7) END, 6) AS x_tol FROM a"""


def page_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.gaps(inputs.glyphs(spark, sf_dir), "x0", "x1", ("doc_id",)).select("doc_id", F.round("mid", 6).alias("mid"), F.round("width", 6).alias("width"))


GAPS = f"""
    WITH g AS ({GLYPHS}), w AS (SELECT *, max(x1) OVER (PARTITION BY doc_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM g)
    SELECT doc_id, round((upto + x0) / 2, 6) AS mid, round(x0 - upto, 6) AS width FROM w WHERE x0 > upto + 0.01"""


def weighted_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.weighted_median(inputs.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ("l_suppkey",)).select("l_suppkey", "median")


MEDIANS = """
    WITH s AS (SELECT l_suppkey, l_quantity, sum(l_extendedprice) AS w FROM lineitem GROUP BY 1, 2), u AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM s)
    SELECT l_suppkey, max(l_quantity) AS median FROM u WHERE upto >= total / 2 GROUP BY 1"""


def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = inputs.documents(spark, sf_dir, f"{PAGE_OF} AS page", "text", "CAST(8 + doc_id % 5 AS DOUBLE) AS fontsize", "doc_id % 9 = 0 AS fig")
    return layout.body_size(blocks, ("page",))


BODY = f"""
    WITH s AS (SELECT {PAGE_OF} AS page, 8 + doc_id % 5 AS s, sum(length(trim(text))) AS w FROM documents WHERE length(trim(text)) >= 60 AND doc_id % 9 <> 0 GROUP BY 1, 2), u AS (SELECT *, sum(w) OVER (PARTITION BY page ORDER BY s ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY page) AS total FROM s)
    SELECT page, min(s)::DOUBLE AS body_size FROM u WHERE upto >= total / 2 GROUP BY page"""


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = inputs.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS line_no", "CAST(l_quantity / 4 AS DOUBLE) AS v", "CAST(l_linenumber AS DOUBLE) AS w")
    return layout.dominant_baseline(words, ("line_no",), 0.3)


BASELINES = """
    WITH w AS (SELECT l_suppkey AS line_no, l_quantity / 4 AS v, l_linenumber::DOUBLE AS w FROM lineitem), n AS (SELECT *, (v - lag(v) OVER (PARTITION BY line_no ORDER BY v) > 0.3)::INT AS new FROM w),
    c AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY line_no ORDER BY v ROWS UNBOUNDED PRECEDING), 0) AS k FROM n), h AS (SELECT line_no, k, sum(w) AS t, row_number() OVER (PARTITION BY line_no ORDER BY sum(w) DESC, k) AS i FROM c GROUP BY 1, 2),
    s AS (SELECT c.line_no, c.v, sum(c.w) AS w FROM c JOIN h ON c.line_no = h.line_no AND c.k = h.k AND h.i = 1 GROUP BY 1, 2), u AS (SELECT *, sum(w) OVER (PARTITION BY line_no ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY line_no) AS total FROM s)
    SELECT line_no, max(v) AS baseline FROM u WHERE upto >= total / 2 GROUP BY line_no"""


def _glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs with their lines. Pages are dealt to more tasks when there are more glyphs, so that what a task sorts does not grow with the table."""
    return layout.baseline_lines(dealt(inputs.glyphs(spark, sf_dir), "doc_id"))


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.words(_glyph_lines(spark, sf_dir), 3.0).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("word_no").cast("long").alias("word_no"), "text", "x0", "x1")


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = layout.with_vocabulary(layout.blocks(layout.lines(layout.words(_glyph_lines(spark, sf_dir), 3.0))))
    return blocks.select("doc_id", F.col("block_no").cast("long").alias("block_no"), layout.joined(F.col("lines"), F.col("vocabulary")).alias("text"), "hpos", "vpos", "width", "height", "fontsize", "bold")


def page_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = inputs.glyphs(spark, sf_dir).withColumns({"si": (F.col("doc_id") * 8 + F.col("si")).cast("int"), "doc_id": F.expr("CAST(floor(doc_id / 50) AS BIGINT)")})
    return pages.read_pages(dense).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "region", "text", "x0", "top")


BLOCKS = (f"{PAGE_OF} AS doc_id", "1 AS page", "CAST(doc_id AS INT) AS seq", "CAST(doc_id AS INT) AS block_no", "substr(text, 1, 200) AS text", "CAST((doc_id * 37) % 400 AS DOUBLE) AS hpos", "CAST((doc_id * 53) % 700 AS DOUBLE) AS vpos", "CAST(80 + doc_id % 120 AS DOUBLE) AS width", "CAST(20 + doc_id % 60 AS DOUBLE) AS height", "CAST(8 + doc_id % 12 AS DOUBLE) AS fontsize", "doc_id % 5 = 0 AS bold")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLOCKS with the whole texts."""
    return inputs.table(spark, sf_dir, "documents").selectExpr(*["text" if b.endswith(" AS text") else b for b in BLOCKS])


#: Cells of two columns and two rows of each page, drawn row by row, some under a wide line that is drawn last: doc_id, drawn, x, y, text.
CELLS = """
    SELECT doc_id, 2 * r + c AS drawn, 20 + 300 * c + doc_id % 5 AS x, 100 + 18 * r + 8 * c + doc_id % 7 AS y, concat('c', CAST(c AS STRING), 'r', CAST(r AS STRING), ' n', CAST(doc_id % 1000 AS STRING)) AS text
    FROM documents CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1) AS a CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1) AS b
    UNION ALL SELECT doc_id, 4, 20, 50, 'one line of words that stands over both of the columns of its page, from left to right' FROM documents WHERE doc_id % 3 = 0"""


def stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages by the order of drawing, read column by column below what spans the columns."""
    cells = spark.sql(CELLS.replace("FROM documents", "FROM {documents}"), documents=inputs.table(spark, sf_dir, "documents"))
    drawn = cells.selectExpr("doc_id", "drawn", "x", "y", "posexplode(split(text, '')) AS (i, text)").where("text != ''")
    glyphs = drawn.selectExpr("doc_id", "1 AS page", "1000 * drawn + i AS si", "text", "CAST(x + 5 * i AS DOUBLE) AS x0", "CAST(x + 5 * i + 5 AS DOUBLE) AS x1", "CAST(y - 8 AS DOUBLE) AS top", "CAST(y + 2 AS DOUBLE) AS bottom", "10.0D AS size", "'Serif' AS fontname")
    return stream.read_stream(glyphs).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "text", "engine")


STREAMED = f"""
    WITH c AS ({CELLS}) SELECT doc_id, CASE WHEN drawn = 4 THEN 0 ELSE 2 * (drawn % 2) + drawn // 2 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END END::BIGINT AS block_no, text, 'stream' AS engine FROM c"""


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = layout.partition(_blocks(spark, sf_dir), 800.0, 10.0, 120.0, 650.0, 150.0)
    return placed.select("doc_id", F.col("seq").cast("long").alias("seq"), "kind", F.col("place").cast("long").alias("place"))


PARTITIONS = f"""
    WITH b AS (SELECT {", ".join("text" if b.endswith(" AS text") else b for b in BLOCKS)} FROM documents),
    h AS (SELECT *, min(CASE WHEN fontsize >= 14 AND vpos + height <= 136 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS head, width > 150 AS wide, vpos + height <= 96 AS top FROM b),
    r AS (SELECT *, CASE WHEN head = 1 THEN 'header' WHEN wide AND vpos > 650 THEN 'footer' WHEN NOT wide AND top AND regexp_matches(text, '@\\S+\\.\\S+|orcid\\.org|ORCID:\\s*\\d|^Authors?\\b') THEN 'meta' WHEN top THEN 'top' ELSE 'body' END AS raw FROM h),
    l AS (SELECT *, last_value(CASE WHEN raw <> 'meta' THEN raw END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead FROM r),
    k AS (SELECT *, CASE WHEN raw = 'meta' AND lead = 'top' OR raw = 'top' THEN 'body' ELSE raw END AS kind FROM l)
    SELECT doc_id, seq::BIGINT AS seq, kind, row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'header' THEN 0 WHEN 'meta' THEN 1 WHEN 'body' THEN 2 ELSE 3 END,
        CASE kind WHEN 'meta' THEN floor(vpos / 5) WHEN 'body' THEN 0 ELSE vpos END, CASE kind WHEN 'meta' THEN hpos WHEN 'body' THEN seq ELSE 0 END, seq) AS place FROM k"""


def column_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_boundaries(_blocks(spark, sf_dir), 600.0).select("doc_id", "boundary")


_SQL_BLOCKS = ", ".join(b.replace("CAST(doc_id AS INT) AS block_no", "doc_id AS block_no") for b in BLOCKS)
COLUMNS = f"""
    WITH b AS (SELECT {_SQL_BLOCKS} FROM documents), c AS (SELECT *, hpos + width / 2 AS cx FROM b), o AS (SELECT *, lag(cx) OVER (PARTITION BY doc_id ORDER BY cx) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY cx) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY before - cx, cx) AS i FROM o WHERE cx - before > 30 AND n > 3 AND total - n >= 2) SELECT doc_id, (before + cx) / 2 AS boundary FROM r WHERE i <= 6"""


def reading_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir).selectExpr("doc_id", "page", "seq", "hpos AS x0", "vpos AS y0", "hpos + width AS x1", "vpos + height AS y1", "fontsize AS line_h")
    return pages.ordered(layout.bands(b)).select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("band").cast("long").alias("band"), F.col("place").cast("long").alias("place"))


#: Of each document a label, the text that it may name (at various distances, heights and sizes), and for some a block below the label.
SIDE = """
    SELECT doc_id % 50 AS doc_id, 1 AS page, 3 * doc_id AS seq, 10.0D AS x0, floor(doc_id / 50) * 100.0D + doc_id % 4 AS y0, 40.0D AS x1, floor(doc_id / 50) * 100.0D + doc_id % 4 + 10 AS y1, 10.0D + doc_id % 3 AS size, doc_id % 2 = 0 AS bold, 10.0D AS line_h FROM documents
    UNION ALL SELECT doc_id % 50, 1, 3 * doc_id + 1, 40.0D + (doc_id % 11) * 8, floor(doc_id / 50) * 100.0D, 60.0D + (doc_id % 11) * 8 + (doc_id % 7) * 20, floor(doc_id / 50) * 100.0D + 10 + (doc_id % 5) * 10, 10.0D, false, 10.0D FROM documents
    UNION ALL SELECT doc_id % 50, 1, 3 * doc_id + 2, 12.0D, floor(doc_id / 50) * 100.0D + 25, 38.0D, floor(doc_id / 50) * 100.0D + 35, 10.0D, false, 10.0D FROM documents WHERE doc_id % 6 = 0"""


def side_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.sql(SIDE.replace("FROM documents", "FROM {documents}"), documents=inputs.table(spark, sf_dir, "documents"))
    labels = layout.side_labels(b)
    after = layout.label_after(labels, b.where("not bold"))
    return labels.join(after, ["doc_id", "page", "seq"]).select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("names").cast("long").alias("names"), F.col("after").cast("long").alias("after"))


SIDE_LABELS = f"""
    WITH b AS ({SIDE.replace("0D", "0::DOUBLE")}), p AS (
        SELECT b.doc_id, b.seq, b.x0, b.x1, b.y0, b.y1, r.seq AS names, row_number() OVER (PARTITION BY b.doc_id, b.seq ORDER BY r.x0 - b.x1, r.seq) AS k FROM b JOIN b AS r ON b.doc_id = r.doc_id AND b.seq <> r.seq
        WHERE r.x0 >= b.x1 AND r.x0 - b.x1 <= 6 * b.size AND r.y0 - 0.5 * b.line_h <= b.y0 AND b.y1 <= r.y1 + 0.5 * b.line_h AND r.y1 - r.y0 >= b.y1 - b.y0 AND (b.bold OR b.size > 1.1 * r.size) AND r.x1 - r.x0 > b.x1 - b.x0
    ), l AS (
        SELECT * FROM p WHERE k = 1 AND NOT EXISTS (
            SELECT 1 FROM b AS q WHERE q.doc_id = p.doc_id AND q.seq <> p.seq AND q.y0 >= p.y1 - 1e-6 AND q.y0 - p.y1 <= 3 * (p.y1 - p.y0)
            AND least(p.x1, q.x1) - greatest(p.x0, q.x0) >= 0.3 * least(p.x1 - p.x0, q.x1 - q.x0))
    )
    SELECT doc_id, seq, names, (SELECT max(q.seq) FROM b AS q WHERE q.doc_id = l.doc_id AND NOT q.bold AND q.seq <= l.seq) AS after FROM l"""


def figure_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of shapes, panels taken out, captions beside what is left."""
    shapes = inputs.table(spark, sf_dir, "part").selectExpr("CAST(floor(p_partkey / 40) AS BIGINT) AS doc_id", "1 AS page", "CASE WHEN p_size % 10 = 0 THEN 'image' ELSE 'rect' END AS kind", "CAST((p_partkey * 29) % 450 AS DOUBLE) AS x0", "CAST((p_partkey * 41) % 700 AS DOUBLE) AS top", "CAST((p_partkey * 29) % 450 + 10 + p_size * 2 AS DOUBLE) AS x1", "CAST((p_partkey * 41) % 700 + 10 + p_size AS DOUBLE) AS bottom")
    blocks = _blocks(spark, sf_dir).withColumn("text", F.when(F.col("seq") % 7 == 0, F.concat(F.lit("Figure "), F.col("seq").cast("string"), F.lit(". "), "text")).otherwise(F.col("text")))
    regions = pages.mask_rows(shapes)
    regions = regions.join(layout.panels(regions, blocks, 10.0).select("doc_id", "page", "region_id"), ["doc_id", "page", "region_id"], "left_anti")
    found = pages.captions(blocks, layout.beside(blocks, regions), 12.0)
    return found.select("doc_id", F.col("cap_no").cast("long").alias("cap_no"), "kind", "label", "source", F.size("blocks").cast("long").alias("n_blocks"))


def region_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside the regions of all parts, by an equi-join on grid rows, and which regions look like tables; pages grow in number with the tables and hold three regions each."""
    words = inputs.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 2 div 45 AS doc_id", "1 AS page", "l_partkey AS word", "l_linenumber AS n", "l_quantity * 10 AS x0", "(l_partkey * 17) % 700 + 0.5D AS y", "l_quantity * 10 + 20 AS x1", "(l_partkey * 17) % 700 - 4.5D AS top", "(l_partkey * 17) % 700 + 5.5D AS bottom", "10.0D AS size")
    regions = inputs.table(spark, sf_dir, "part").selectExpr("p_partkey div 3 AS doc_id", "1 AS page", "CAST(p_partkey AS INT) AS region_id", "CAST(p_size * 4 AS DOUBLE) AS x0", "CAST(p_size * 4 + 200 AS DOUBLE) AS x1", "CAST((p_partkey * 7) % 500 AS DOUBLE) AS top", "CAST((p_partkey * 7) % 500 + 160 AS DOUBLE) AS bottom")
    held = layout.inside(words.distinct(), regions, "x0", "y").where("region_id is not null")
    return layout.table_like(held).join(held.groupBy("doc_id", "page", "region_id").agg(F.count("*").alias("n_words")), ["doc_id", "page", "region_id"]).select("doc_id", F.col("region_id").cast("long").alias("region_id"), "n_words", "table_like")


INSIDE = """
    WITH w AS (SELECT DISTINCT l_orderkey * 2 // 45 AS doc_id, l_partkey AS word, l_linenumber AS n, l_quantity * 10 AS x0, ((l_partkey * 17) % 700)::DOUBLE + 0.5 AS y FROM lineitem),
    r AS (SELECT p_partkey // 3 AS doc_id, p_partkey AS region_id, p_size * 4 AS a, p_size * 4 + 200 AS b, (p_partkey * 7) % 500 AS t, (p_partkey * 7) % 500 + 160 AS u FROM part),
    h AS (SELECT w.doc_id, w.word, w.n, w.x0, w.y, min(region_id) AS region_id FROM w JOIN r ON w.doc_id = r.doc_id AND x0 BETWEEN a AND b AND y BETWEEN t AND u GROUP BY ALL),
    g AS (SELECT doc_id, region_id, round_even(0, 0) AS z, floor(y / 8.0 + 0.5) AS row, floor(x0 / 15.0 + 0.5) AS col FROM h),
    rw AS (SELECT doc_id, region_id, row, count(*) AS n FROM g GROUP BY ALL), f AS (SELECT doc_id, region_id, sum(n) AS words, count(*) AS rows_, sum((n >= 2)::INT) AS multi FROM rw GROUP BY ALL),
    s AS (SELECT doc_id, region_id, count(*) AS repeated FROM (SELECT g.doc_id, g.region_id, g.col, count(DISTINCT g.row) AS k, any_value(f.multi) AS multi FROM g JOIN rw ON g.doc_id = rw.doc_id AND g.region_id = rw.region_id AND g.row = rw.row AND rw.n >= 2 JOIN f ON f.doc_id = g.doc_id AND f.region_id = g.region_id GROUP BY 1, 2, 3) WHERE k >= 0.6 * multi GROUP BY 1, 2)
    SELECT f.doc_id, f.region_id, words::BIGINT AS n_words, words >= 6 AND rows_ >= 3 AND multi >= 0.6 * rows_ AND coalesce(repeated, 0) >= 2 AS table_like FROM f LEFT JOIN s ON f.doc_id = s.doc_id AND f.region_id = s.region_id"""


def interleaved_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.table(spark, sf_dir, "documents").selectExpr(f"{PAGE_OF} AS doc_id", "1 AS page", "CAST(doc_id AS INT) AS line_no", "CAST(doc_id % 2 * 300 AS DOUBLE) AS x0", "CAST(doc_id % 2 * 300 + 200 AS DOUBLE) AS x1", "CAST(doc_id % 20 div 2 * 12 AS DOUBLE) AS bottom", "10.0D AS size")
    return pages.lane_rows(lines).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("lane").cast("long").alias("lane"))


def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a text is a line of its page; sizes change each third line."""
    lines = inputs.table(spark, sf_dir, "documents").selectExpr("doc_id", "posexplode(split(text, chr(10))) AS (line_no, text)").selectExpr("doc_id", "line_no", "text", "line_no * 12.0D AS top", "line_no * 12.0D + 10 AS bottom", "CAST(10 + (doc_id + line_no div 3) % 7 AS DOUBLE) AS size")
    return layout.title_candidate(lines)


def phantom_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = inputs.glyphs(spark, sf_dir)
    return layout.blank_in_glyph(g, ("doc_id",)).groupBy("doc_id").agg(F.count("*").alias("n"))


PHANTOMS = f"""
    WITH g AS ({GLYPHS}), b AS (SELECT * FROM g WHERE text = ' '), k AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = b.doc_id AND g.text <> ' ' AND b.x0 >= g.x0 AND b.x1 <= g.x1 AND abs(b.top - g.top) <= 1.0))
    SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM g WHERE text <> ' ' UNION ALL SELECT doc_id FROM k) GROUP BY doc_id"""

# --- plans ------------------------------------------------------------------------------------------------------------------------------


def metadata_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, f"{inputs.HEAD} AS text")
    r = document.documents(docs)
    return r.select("doc_id", "title", F.array_join(F.transform("creators", lambda c: c["name"]), "; ").alias("creators"), F.size("sections").cast("long").alias("n_sections"), "language")


def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "CAST(NULL AS STRING) AS publisher", "CAST(doc_id % 3 AS INT) AS year", "lang AS language")
    return files.json_records(docs, ["publisher", "year", "language"]).select("doc_id", "json")


def records_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step from a text and a response to a record and its report; responses are cut off, fenced or no JSON in turn."""
    answer = """concat(CASE WHEN doc_id % 4 = 1 THEN '```json ' ELSE '' END, '{"titles":[{"title":"Depth of the River ', CAST(doc_id AS STRING), '"}],"creators":[{"name":"Doe, Jane","givenName":"Jane","familyName":"Doe","affiliation":"Alder"}],"subjects":["rivers","Rivers","boats"],"domain":"other",',
        '"content":{"sections":[{"sectionTitle":"Methods","sectionContent":"We measured the depth of the river twice a day."}]},"fundingReferences":[{"funderName":"Agency","awardNumber":" x-', CAST(doc_id % 10 AS STRING), '. "}]', CASE WHEN doc_id % 4 = 2 THEN '' ELSE '}' END, CASE WHEN doc_id % 4 = 1 THEN ' ```' ELSE '' END)"""
    docs = inputs.documents(spark, sf_dir, f"concat('Depth of the River ', CAST(doc_id AS STRING), chr(10), 'Jane Doe1, Max van Dam2', chr(10), '1 University of Alder, 2 Institute of Boats', chr(10), '## Methods', chr(10), 'We measured the depth of the river twice a day.', chr(10), '## Results', chr(10), 'The nets were dry all summer long in the village by the old road.') AS text", f"CASE WHEN doc_id % 4 = 3 THEN 'no answer' ELSE {answer} END AS response")
    options = Options(structurer=lambda d: docs.select("doc_id", "response"))
    made = document.record_texts(document.documents(docs, options), options)
    return made.select("doc_id", "title", F.array_join(F.transform("creators", lambda c: F.concat(c["name"], F.lit(" @ "), F.array_join(c["affiliation"]["name"], " / "))), "; ").alias("creators"), F.array_join(F.transform("sections", lambda s: F.concat(F.coalesce(s["sectionTitle"], F.lit("")), F.lit(": "), s["sectionContent"])), " | ").alias("sections"), F.array_join("subjects", ", ").alias("subjects"), F.array_join(F.transform("funding", lambda f: f["awardNumber"]), ", ").alias("awards"), F.col("n_reclaimed").cast("long").alias("n_reclaimed"), F.col("report.valid").alias("valid"), F.array_join("report.field_issues", " | ").alias("issues"))


RECORDS = """
    SELECT doc_id, concat('Depth of the River ', doc_id) AS title, 'Doe, Jane @ University of Alder; van Dam, Max @ Institute of Boats' AS creators,
        CASE WHEN doc_id % 4 = 3 THEN concat(': Depth of the River ', doc_id, chr(10), 'Jane Doe1, Max van Dam2', chr(10), '1 University of Alder, 2 Institute of Boats | ') ELSE '' END || 'Methods: We measured the depth of the river twice a day. | Results: The nets were dry all summer long in the village by the old road.' AS sections,
        CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'rivers, boats' END AS subjects, CASE WHEN doc_id % 4 = 3 THEN '' ELSE concat('X-', doc_id % 10) END AS awards, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 1 END::BIGINT AS n_reclaimed, true AS valid,
        CASE WHEN doc_id % 4 = 3 THEN 'Missing required fields: conference | content.sections[0] missing ''sectionTitle''' ELSE 'Missing required fields: conference' END AS issues FROM documents"""


def schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with one fault each, by the document's number."""
    kinds = ['{"creators":[{"name":"Doe, J"}],"titles":[{"title":"A river"}],"language":"en"}', "{}", '{"creators":{},"titles":[]}', '{"creators":[{"name":""},{"x":1},"y"],"titles":[{"title":5}]}', '{"creators":[],"titles":[{"title":"T"}],"language":"English","formats":[1]}', "no json", '{"creators":[{"name":"D","nameType":"Robot","affiliation":["A",{"name":"B"},{}]}],"titles":[{"title":"T"}],"publicationYear":"2020"}']
    case = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " END"
    x = inputs.documents(spark, sf_dir, f"{case} AS json").withColumn("e", records.schema_errors(F.col("json")))
    return x.select("doc_id", F.array_join(F.transform("e", lambda e: F.concat(e["path"], F.lit(" "), e["message"])), "; ").alias("errors"))


SCHEMA_ERRORS = """
    SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '(root) has no creators; (root) has no titles' WHEN 2 THEN 'creators is not of type array; titles has fewer than 1 items'
        WHEN 3 THEN 'creators.0.name is shorter than 1; creators.1 has no name; creators.2 is not of type object; titles.0.title is not of type string' WHEN 4 THEN 'language does not match ^[a-z]{2,3}(-[A-Za-z]+)?$; formats.0 is not of type string' WHEN 5 THEN '(root) is no JSON'
        ELSE 'publicationYear is not of type integer or null; creators.0.nameType is none of Personal, Organizational; creators.0.affiliation.2 has no name' END AS errors FROM documents"""


JSON = """SELECT doc_id, concat('{"publisher":null,"year":', doc_id % 3, ',"language":"', lang, '"}') AS json FROM documents"""


#: Alternatives and references over a document's own columns.
ALTERNATIVES = {
    "type": "object", "required": ["id", "lang"], "additionalProperties": False,
    "$defs": {"short": {"type": "string", "maxLength": 400}, "count": {"type": "integer", "minimum": 20, "maximum": 2000}},
    "properties": {
        "id": {"oneOf": [{"type": "integer", "maximum": 600}, {"type": "integer", "minimum": 400}]}, "lang": {"enum": ["en", "de", "fr"]}, "size": {"$ref": "#/$defs/count"},
        "text": {"anyOf": [{"$ref": "#/$defs/short"}, {"type": "string", "pattern": "^[A-M]"}]}, "lines": {"type": "array", "minItems": 2, "maxItems": 12, "items": {"allOf": [{"$ref": "#/$defs/short"}, {"minLength": 4}]}},
        "source": {"not": {"const": "src0"}},
    },
}


def schema_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records against a schema with alternatives and references; some have a field too many."""
    record = "to_json(named_struct('id', doc_id, 'lang', lang, 'size', length(text), 'text', text, 'lines', split(text, chr(10)), 'source', source, 'more', CASE WHEN doc_id % 7 = 0 THEN 1 END)) AS json"
    x = inputs.table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", record).withColumn("e", schema.errors(F.col("json"), ALTERNATIVES))
    return x.select("doc_id", F.array_join(F.transform("e", lambda y: F.concat_ws(" ", y["path"], y["message"])), "; ").alias("errors"))


ALTERNATIVE_ROWS = """
    WITH d AS (SELECT doc_id, lang, source, text, length(text) AS n, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, array_to_string(list_filter(list_concat([
        CASE WHEN lang IS NULL THEN '(root) has no lang' END, CASE WHEN doc_id BETWEEN 400 AND 600 THEN 'id meets several alternatives' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang is none of en, de, fr' END,
        CASE WHEN n < 20 THEN 'size is less than 20' WHEN n > 2000 THEN 'size is more than 2000' END, CASE WHEN n > 400 AND NOT regexp_matches(text, '^[A-M]') THEN 'text meets none of the alternatives' END,
        CASE WHEN len(l) < 2 THEN 'lines has fewer than 2 items' WHEN len(l) > 12 THEN 'lines has more than 12 items' END],
        list_transform(l, lambda x, i: CASE WHEN length(x) > 400 THEN 'lines.' || (i - 1) || ' is longer than 400' WHEN length(x) < 4 THEN 'lines.' || (i - 1) || ' is shorter than 4' END),
        [CASE WHEN source = 'src0' THEN 'source is what it must not be' END, CASE WHEN doc_id % 7 = 0 THEN '(root) has no place for more' END]), lambda x: x IS NOT NULL), '; ') AS errors FROM d"""


def better_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attempts for each document, scored by the length of its text and by its lines."""
    a = inputs.documents(spark, sf_dir, "explode(array(1, 2)) AS attempt", "coalesce(text, '') AS text")
    score = F.when(F.col("attempt") == 1, F.length("text") % 7).otherwise(F.size(F.split("text", "\n")) % 5)
    return records.better_attempt(a.select("doc_id", "attempt", score.cast("double").alias("score"))).select("doc_id", F.col("attempt").cast("long").alias("attempt"), "score")


ATTEMPTS = """
    WITH s AS (SELECT doc_id, length(coalesce(text, '')) % 7 AS a, len(string_split(coalesce(text, ''), chr(10))) % 5 AS b FROM documents)
    SELECT doc_id, CASE WHEN a <= b THEN 1::BIGINT ELSE 2 END AS attempt, least(a, b)::DOUBLE AS score FROM s"""


def copied_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim strings of responses against their texts; every third one invents its end."""
    docs = inputs.documents(spark, sf_dir, "text", "to_json(named_struct('title', concat(split(text, ' ')[0], CASE WHEN doc_id % 3 = 0 THEN ' quite-invented' ELSE '' END), 'note', 'free')) AS response")
    return copying.invented(docs).select("doc_id", "key", F.round("share", 6).alias("share"))


COPIED = r"""
    SELECT doc_id, 'title' AS key, CASE WHEN doc_id % 3 = 0 THEN round(length(w)::DOUBLE / (length(w) + 15), 6) ELSE 1.0::DOUBLE END AS share FROM (SELECT doc_id, split_part(text, ' ', 1) AS w FROM documents)"""


def figure_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = inputs.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS doc_id", "1 AS page", "l_partkey AS line_no", "l_linenumber AS word_no", "CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 7 END AS region_id", "CASE WHEN l_partkey % 7 % 2 = 0 THEN 'image' ELSE 'graphic' END AS kind", "CASE WHEN l_linenumber % 3 < 2 THEN CAST(l_partkey AS STRING) ELSE 'word' END AS text", "CASE WHEN l_partkey % 11 = 0 THEN 14.0D ELSE 10.0D END AS size", "'Sans' AS fontname", "CAST(l_partkey AS DOUBLE) AS top", "CAST(l_partkey + 10 AS DOUBLE) AS bottom")
    return layout.figure_words(words, 10.0).groupBy("doc_id").agg(F.sum(F.col("label").cast("long")).alias("n_labels"), F.count("*").alias("n_words"))


QUERIES = {
    "schema_alternatives": schema_alternatives,
    "name_matches": name_matches,
    "numbered_affiliations": numbered_affiliations, "copied_strings": copied_strings, "figure_words": figure_words,
    "organisations": organisations, "persons": persons, "funders": funders, "headers": headers, "creators_grounded": creators_grounded, "joined_creators": joined_creators, "marker_runs": marker_runs, "json_repairs": json_repairs, "captions_normalised": captions_normalised,
    "affiliations_coerced": affiliations_coerced, "funding_normalised": funding_normalised, "subjects_normalised": subjects_normalised, "sections_kept": sections_kept, "validations": validations, "file_kinds": file_kinds, "text_sources": text_sources, "mode_sizes": mode_sizes,
    "glyph_stats": glyph_stats, "page_gaps": page_gaps, "weighted_medians": weighted_medians, "body_sizes": body_sizes, "baselines": baselines, "page_words": page_words, "page_blocks": page_blocks, "page_reading": page_reading, "partitions": partitions, "column_cuts": column_cuts,
    "reading_bands": reading_bands, "side_labels": side_labels, "figure_captions": figure_captions, "region_words": region_words, "interleaved_lanes": interleaved_lanes, "title_candidates": title_candidates, "phantom_blanks": phantom_blanks, "metadata_records": metadata_records,
    "record_json": record_json, "records_whole": records_whole, "stream_pages": stream_pages, "schema_errors": schema_errors, "better_attempts": better_attempts,
}
ORACLE_SQL = {
    "schema_alternatives": ALTERNATIVE_ROWS,
    "name_matches": NAME_MATCHES,
    "numbered_affiliations": NUMBERED, "copied_strings": COPIED,
    "organisations": ORGANISATIONS, "persons": PERSONS, "funders": FUNDERS, "headers": HEADERS, "joined_creators": JOINED, "json_repairs": REPAIRS, "captions_normalised": CAPTION_ROWS, "affiliations_coerced": AFFILIATIONS, "funding_normalised": FUNDING,
    "subjects_normalised": SUBJECTS, "sections_kept": KEPT, "validations": VALIDATIONS, "file_kinds": KINDS, "text_sources": SOURCES, "mode_sizes": MODES, "glyph_stats": STATS, "page_gaps": GAPS, "weighted_medians": MEDIANS, "body_sizes": BODY, "baselines": BASELINES,
    "column_cuts": COLUMNS, "side_labels": SIDE_LABELS, "creators_grounded": GROUNDED, "marker_runs": MARKS, "partitions": PARTITIONS, "region_words": INSIDE, "phantom_blanks": PHANTOMS, "record_json": JSON, "records_whole": RECORDS, "stream_pages": STREAMED, "schema_errors": SCHEMA_ERRORS, "better_attempts": ATTEMPTS,
}

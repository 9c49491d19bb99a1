"""Queries over text: lines, tokens, predicates, identifiers, licenses, titles, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed, text
from lectern.operators import identifiers, language, licenses, lines, metrics, records

from . import inputs

T = r"'[\p{L}\p{N}\p{M}]+'"
LINES = "SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(%s, chr(10)) AS l FROM documents)"


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, f"{inputs.HEADED} AS text")
    found = lines.section_rows(lines.lines_of(docs))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "title", F.length("content").cast("long").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


SECTIONS = f"""
    WITH l AS ({LINES % inputs.HEADED}), n AS (SELECT *, sum((line LIKE '## %')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM l),
    g AS (SELECT doc_id, no, min(pos) AS pos, max(CASE WHEN line LIKE '## %' THEN trim(substr(line, 4)) END) AS title,
        coalesce(string_agg(CASE WHEN line NOT LIKE '## %' AND trim(line) <> '' THEN trim(line) END, chr(10) ORDER BY pos), '') AS content FROM n GROUP BY doc_id, no)
    SELECT doc_id, pos::BIGINT AS pos, title, length(content)::BIGINT AS n_chars, md5(content) AS content_md5 FROM g WHERE content <> '' OR title IS NOT NULL"""


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = lines.line_runs(lines.lines_of(inputs.documents(spark, sf_dir, "text"))).where("n > 1")
    return runs.select("doc_id", F.col("start").cast("long").alias("start"), "n", F.md5(F.col("line").cast("binary")).alias("line_md5"))


LINE_RUNS = f"""
    WITH l AS ({LINES % "text"}), r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS island FROM l WHERE trim(line) <> '')
    SELECT doc_id, min(pos)::BIGINT AS start, count(*) AS n, md5(line) AS line_md5 FROM r GROUP BY doc_id, line, island HAVING count(*) > 1"""


def collapsed_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and cycles of lines cut to three copies; each line of every text is written twice so that there are some."""
    docs = inputs.documents(spark, sf_dir, "concat(text, repeat(concat(chr(10), 'a | b', chr(10), 'c'), CAST(doc_id % 6 AS INT))) AS text")
    return docs.select("doc_id", F.length("text").cast("long").alias("n_before"), lines.collapsed("text").alias("text")).select("doc_id", "n_before", F.length("text").cast("long").alias("n_after"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def ocr_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "concat('# Title ', CAST(doc_id AS STRING), chr(10), chr(10), '**Methods:**', chr(10), text, chr(10), chr(10), 'Main Results', chr(10), 'of ', CAST(doc_id AS STRING)) AS text")
    return lines.marked_headers(lines.lines_of(docs)).where("header or pos = 0").select("doc_id", F.col("pos").cast("long").alias("pos"), "line", "header")


def inline_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "concat(text, '. REFERENCES: 1. Doe FUNDING: none. TWINS — Our second sample') AS a", "concat('Figure 1: Depth. See Table 9: not here. Figure 2: Boats ', CAST(doc_id AS STRING)) AS b")
    return docs.select("doc_id", F.size(F.split(lines.inline_split(F.col("a")), "\n## ")).alias("n_parts"), lines.inline_captions(F.col("b")).alias("captions"))


def normalised_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal in letters and digits: the first of each, and how many there are."""
    docs = inputs.documents(spark, sf_dir, "text").select("doc_id", F.md5(text.alphanumeric("text").cast("binary")).alias("k"))
    return docs.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").select("doc_id", "n")


DUPLICATES = r"""
    SELECT min(doc_id) AS doc_id, count(*) AS n FROM (
        SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9\s]', '', 'g'), '\s+', ' ', 'g'))) AS k FROM documents) GROUP BY k HAVING count(*) > 1"""


def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "concat(text, ' 3.5 of ', CAST(doc_id % 13 AS STRING), '. and 7') AS text")
    return docs.select("doc_id", F.array_join(F.array_sort(text.numerals("text")), " ").alias("numbers"))


NUMERALS = r"""
    WITH m AS (SELECT doc_id, regexp_extract_all(concat(text, ' 3.5 of ', CAST(doc_id % 13 AS STRING), '. and 7'), '\d+\.?\d*') AS f FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(f, list_transform(list_filter(f, lambda x: contains(x, '.')), lambda x: split_part(x, '.', 1))))), ' ') AS numbers FROM m"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokens("text")
    return inputs.documents(spark, sf_dir, "text").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.size(text.letter_words("text")).cast("long").alias("n_words"))


TOKENS = rf"""
    SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, len(regexp_extract_all(text, '\p{{L}}{{2,}}'))::BIGINT AS n_words
    FROM (SELECT doc_id, text, regexp_extract_all(lower(text), {T}) AS t FROM documents)"""


def shingle_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-grams of each line that also occur in every second line of its document."""
    rows = lines.lines_of(inputs.documents(spark, sf_dir, "text"))
    found = lines.coverage(rows, rows.where("pos % 2 = 0").select("doc_id", F.col("line").alias("text")))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "n_grams", "n_hit")


COVERAGE = rf"""
    WITH l AS ({LINES % "text"}), t AS (SELECT doc_id, pos, regexp_extract_all(lower(line), {T}) AS t FROM l),
    g AS (SELECT doc_id, pos, array_to_string(list_slice(t, i, i + 2), ' ') AS g FROM (SELECT *, unnest(range(1, len(t) - 1)) AS i FROM t WHERE len(t) >= 3)),
    c AS (SELECT DISTINCT doc_id, g FROM g WHERE pos % 2 = 0)
    SELECT g.doc_id, g.pos::BIGINT AS pos, count(*) AS n_grams, count(c.g) AS n_hit FROM g LEFT JOIN c ON g.doc_id = c.doc_id AND g.g = c.g GROUP BY 1, 2"""


def uncaptured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.lines_of(inputs.documents(spark, sf_dir, "text"))
    found = lines.uncaptured(rows, rows.where("pos % 2 = 0").select("doc_id", F.col("line").alias("text")), rows.where("pos = 1").select("doc_id", F.col("line").alias("text")))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "uncaptured")


def _line_rows(spark: SparkSession, sf_dir: str, s: str) -> DataFrame:
    """line_id and s, an expression of pos and line, of every line of every text."""
    rows = lines.lines_of(inputs.documents(spark, sf_dir, "text"))
    return rows.select(F.concat_ws(":", "doc_id", "pos").alias("line_id"), F.expr(s).alias("s"))


def _sql_rows(s: str) -> str:
    return f"SELECT concat(doc_id, ':', pos) AS line_id, {s} AS s FROM ({LINES % 'text'})"


def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every predicate over every line of every text; every seventh line in capitals, every eighth without its last mark, every ninth as a label."""
    s = F.col("s")
    return _line_rows(spark, sf_dir, SHAPED).select("line_id", text.is_placeholder(s).alias("placeholder"), text.is_section_label(s).alias("section_label"), text.is_section_keyword(s).alias("keyword"), text.is_bare_label(s).alias("bare_label"), text.looks_like_header(s).alias("header"), text.looks_like_sentence(s).alias("sentence"), text.is_author_line(s).alias("author_line"), text.is_rights_junk(s).alias("junk"), text.ran_into_body(s).alias("body"), text.affiliation_like(s).alias("affiliation"))


SHAPED = "CASE WHEN pos % 7 = 6 THEN translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN pos % 8 = 7 THEN rtrim('.', line) WHEN pos % 9 = 8 THEN concat('Methods ', pos % 3, ':') ELSE line END"
PREDICATES = rf"""
    WITH d AS ({_sql_rows(SHAPED.replace("rtrim('.', line)", "rtrim(line, '.')"))}), w AS (
        SELECT line_id, s, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') AS w, regexp_extract_all(s, '\p{{L}}{{2,}}') AS a,
            lower(trim(regexp_replace(s, '[#*•:/\\\-–—]', ' ', 'g'))) AS t, length(s) - length(replace(s, ',', '')) AS c FROM d
    ), x AS (
        SELECT *, len(w)::DOUBLE AS n, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS tw,
            len(list_filter(w, lambda x: regexp_matches(x, '\d|^[*†‡§¶,]+$'))) AS dg, len(list_filter(w, lambda x: x IN (',', '&', 'and', ';'))) AS sp, len(list_filter(w, lambda x: regexp_matches(x, '^(?:[A-Z]\.)+,?$'))) AS ini FROM w
    )
    SELECT line_id,
        trim(regexp_replace(lower(trim(s)), '[.…]+$', '')) IN {_list(fixed.PLACEHOLDERS)} OR regexp_matches(trim(regexp_replace(lower(trim(s)), '[.…]+$', '')), '^keyword\s*\d*$') AS placeholder,
        length(t) <= 45 AND len(tw) > 0 AND len(list_filter(tw, lambda x: x NOT IN {_list(fixed.SECTION_LABELS)})) = 0 AS section_label,
        lower(trim(regexp_replace(trim(s), '[:.\s]+$', ''))) IN {_list(fixed.SECTION_KEYWORDS)} AS keyword,
        length(trim(s)) <= 60 AND regexp_matches(trim(s), '^[A-Za-z][A-Za-z0-9&,''()/\- ]{{0,58}}:$') AS bare_label,
        n BETWEEN 1 AND 8 AND length(s) <= 60 AND regexp_matches(s, '^[\p{{Lu}}\p{{Nd}}]') AND NOT regexp_matches(s, '[.,;]$') AND NOT regexp_matches(s, '(?i)^(?:fig(?:ure)?|table|tab)\.?\s*\d') AS header,
        n >= 6 AND len(a) >= 5 AND coalesce(list_sum(list_transform(a, lambda x: length(x))), 0) / greatest(length(replace(s, ' ', '')), 1) >= 0.6 AND NOT regexp_matches(s, '@\S+\.\S+|https?://|www\.') AND len(list_filter(a, lambda x: x = lower(x) AND x <> upper(x))) > 0 AS sentence,
        CASE WHEN n = 0 THEN true ELSE dg / n > 0.25 OR (c >= 3 AND c / n > 0.3) OR (ini >= 2 AND (ini + sp) / n >= 0.3)
            OR (c >= 2 AND c / n >= 0.15 AND len(list_filter(w, lambda x: NOT (regexp_matches(x, '^(?:\p{{Lu}}|\P{{L}})') OR x = 'and'))) = 0) END AS author_line,
        trim(s) = '' OR length(trim(s)) > 200 OR regexp_matches(trim(s), '(?i){"|".join(f"(?:{p})" for p in fixed.RIGHTS_JUNK if "(?!" not in p)}') OR regexp_matches(trim(s), '(?i)^https?://') AS junk,
        length(s) > 180 OR regexp_matches(s, '(?:^|[^\p{{L}}\p{{N}}_])[a-zà-ÿ]{{2,}}(?:\s+[a-zà-ÿ]{{2,}}){{4,}}(?:[^\p{{L}}\p{{N}}_]|$)') OR regexp_matches(s, '(?:^|[^\p{{L}}\p{{N}}_])[A-Z]{{2,}}(?:\s+[A-Z]{{2,}}){{4,}}(?:[^\p{{L}}\p{{N}}_]|$)') AS body,
        NOT regexp_matches(s, '^[•▪●◦*"“–-]') AND n <= 24 AND NOT regexp_matches(s, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:we|our|this|these|was|were|is|are|have|has|that|which)(?:[^\p{{L}}\p{{N}}_]|$)') AS affiliation
    FROM x"""


#: Lines with labels of captions before them, and lines as they are.
LABELLED = "CASE pos % 5 WHEN 0 THEN concat('Figure ', pos, '. ', line) WHEN 1 THEN concat('TABLE IV | ', line) WHEN 2 THEN concat('Fig S', pos, 'a ', line) WHEN 3 THEN concat('the figure ', line) ELSE line END"


def caption_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of captions at the beginning of every line of every text."""
    lab = text.caption_label("s")
    rows = _line_rows(spark, sf_dir, LABELLED).where(lab.isNotNull())
    return rows.select("line_id", lab["kind"].alias("kind"), lab["num"].alias("num"), lab["has_sep"].alias("has_sep"), text.without_label("s").alias("rest"))


CAPTIONS = rf"""
    WITH d AS ({_sql_rows(LABELLED)}), m AS (SELECT line_id, s, regexp_extract(s, '{text.LABEL}', ['w', 'num', 'sep', 'sep2']) AS m, regexp_extract(s, '{text.LABEL}', 0) AS whole FROM d)
    SELECT line_id, CASE WHEN lower(m.w) LIKE 'tab%' THEN 'table' ELSE 'figure' END AS kind, nullif(m.num, '') AS num, m.sep <> '' OR m.sep2 <> '' AS has_sep, trim(CASE WHEN m.sep <> '' OR m.sep2 <> '' THEN substr(s, length(whole) + 1) ELSE s END) AS rest FROM m WHERE m.w <> ''"""


def merged_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole lines of a text the first is found; the model has the last, one that is not there, and one of which some words are."""
    docs = inputs.documents(spark, sf_dir, "array(split(text, chr(10))[0]) AS found", "array(element_at(split(text, chr(10)), -1), 'words that are not there at all', concat('words ', element_at(split(text, chr(10)), -1)), split(text, chr(10))[0]) AS model", "text")
    merged = docs.select("doc_id", lines.merged_captions(F.col("found"), F.col("model"), F.col("text")).alias("c"))
    return merged.select("doc_id", F.size("c").alias("n_captions"))


def caption_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "concat(text, ' Figure 3. Depth of the  river by day and night ', CAST(doc_id AS STRING)) AS text", "array('Figure 3. Depth of the river by day and night') AS captions")
    return docs.select("doc_id", F.length(lines.captions_removed("text", "captions")).cast("long").alias("n_chars"))


def identifiers_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.found_rows(inputs.documents(spark, sf_dir, f"{inputs.CITED} AS text")).select("doc_id", "scheme", F.col("pos").cast("long").alias("pos"), "value")


def _found(scheme: str, values: str) -> str:
    return f"SELECT doc_id, '{scheme}' AS scheme, {values} AS v FROM d"


IDENTIFIERS = f"""
    WITH d AS (SELECT doc_id, {inputs.CITED} AS t FROM documents), a AS (
        {_found("orcid", "regexp_extract_all(t, '" + fixed.IN_TEXT["orcid"] + "', 1)")} UNION ALL {_found("arxiv", "regexp_extract_all(t, '" + fixed.IN_TEXT["arxiv"] + "', 1)")} UNION ALL
        {_found("ror", "regexp_extract_all(t, '" + fixed.IN_TEXT["ror"] + "', 1)")} UNION ALL {_found("isni", "regexp_extract_all(t, '" + fixed.IN_TEXT["isni"] + "', 1)")} UNION ALL {_found("grid", "regexp_extract_all(t, '" + fixed.IN_TEXT["grid"] + "', 1)")} UNION ALL
        {_found("crossref_funder", "list_transform(regexp_extract_all(t, '" + fixed.IN_TEXT["crossref_funder"] + "', 1), lambda x: concat('10.13039/', x))")} UNION ALL
        {_found("doi", "list_filter(list_transform(regexp_extract_all(t, '" + fixed.IN_TEXT["doi"].replace("'", "''") + "', 1), lambda x: regexp_replace(x, '[.]+$', '')), lambda x: x NOT LIKE '10.13039/%')")}
    ), u AS (SELECT doc_id, scheme, unnest(v) AS value, generate_subscripts(v, 1) AS i FROM a), f AS (SELECT doc_id, scheme, value, min(i) AS i FROM u GROUP BY 1, 2, 3)
    SELECT doc_id, scheme, row_number() OVER (PARTITION BY doc_id, scheme ORDER BY i) - 1 AS pos, value FROM f"""

VALUES = (
    "CASE doc_id % 9 WHEN 0 THEN 'https://orcid.org/0000-0002-1825-0097' WHEN 1 THEN '10.13039/501100001659' WHEN 2 THEN concat('https://dx.doi.org/10.1000/A', CAST(doc_id AS STRING)) WHEN 3 THEN 'arXiv:2101.00001'"
    " WHEN 4 THEN 'https://ror.org/03yrm5c26' WHEN 5 THEN 'https://isni.org/isni/000000012146438X' WHEN 6 THEN 'https://grid.ac/grid.1.a' WHEN 7 THEN concat('doi: 10.1000/b', CAST(doc_id AS STRING)) ELSE substr(text, 1, 20) END"
)


def identifier_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, f"{VALUES} AS v")
    s = identifiers.scheme(F.col("v"))
    return docs.select("doc_id", s["scheme"].alias("scheme"), s["scheme_uri"].alias("scheme_uri"), identifiers.canonical_doi(F.col("v")).alias("bare"), identifiers.orcid_url(F.col("v")).alias("orcid"))


SCHEMES = f"""
    SELECT doc_id, scheme, scheme_uri, CASE WHEN regexp_replace(v, '{fixed.DOI_PREFIX}', '') LIKE '10.%' THEN trim(regexp_replace(v, '{fixed.DOI_PREFIX}', '')) ELSE v END AS bare,
        CASE WHEN regexp_matches(v, '(?:[0-9]{{4}}-){{3}}[0-9]{{3}}[0-9X]') AND v NOT LIKE 'http%' THEN concat('https://orcid.org/', regexp_extract(v, '(?:[0-9]{{4}}-){{3}}[0-9]{{3}}[0-9X]')) ELSE v END AS orcid
    FROM (SELECT doc_id, {VALUES} AS v, CASE {" ".join(f"WHEN regexp_matches(trim({VALUES}), '{p}') THEN '{k}'" for k, p in fixed.OF_VALUE)} END AS k FROM documents) LEFT JOIN
        (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in fixed.SCHEMES.items())}) AS s(key, scheme, scheme_uri) ON k = key"""


def identifiers_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, f"{inputs.CITED} AS text", "array(named_struct('identifier', '10.5555/Z', 'identifierType', CAST(NULL AS STRING))) AS ids", "array(array(), array('https://orcid.org/0000-0001-5109-3700')) AS creators", "array(named_struct('funderName', 'A', 'funderIdentifier', CAST(NULL AS STRING), 'funderIdentifierType', CAST(NULL AS STRING), 'schemeUri', CAST(NULL AS STRING))) AS refs")
    x = docs.withColumn("f", identifiers.found(F.col("text")))
    ids = identifiers.typed_identifiers(identifiers.placed_identifiers(F.col("ids"), F.col("f")["doi"], F.col("f")["arxiv"]))
    orcids = identifiers.placed_orcids(F.col("creators").cast("array<array<string>>"), F.col("f")["orcid"])
    refs = identifiers.placed_funders(F.col("refs"), F.coalesce(F.col("f")["crossref_funder"], F.array().cast("array<string>")))
    return x.select("doc_id", F.to_json(ids).alias("identifiers"), F.to_json(orcids).alias("orcids"), F.to_json(identifiers.typed_funding(refs)).alias("funding"))


PLACED = """
    SELECT doc_id, concat('[{"identifier":"10.5555/Z","identifierType":"DOI"},{"identifier":"10.', 1000 + doc_id % 9000, '/ab.', doc_id, '","identifierType":"DOI"},{"identifier":"arXiv:21', lpad((doc_id % 100)::VARCHAR, 2, '0'), '.', lpad((doc_id % 100000)::VARCHAR, 5, '0'), 'v2","identifierType":"arXiv"}]') AS identifiers,
        concat('[[', CASE doc_id % 3 WHEN 0 THEN '"https://orcid.org/0000-0002-1825-0097"' WHEN 1 THEN '"https://orcid.org/0000-0002-1825-009X"' ELSE '' END, '],["https://orcid.org/0000-0001-5109-3700"]]') AS orcids,
        concat('[{"funderName":"A"', CASE WHEN doc_id % 2 = 0 THEN ',"funderIdentifier":"https://doi.org/10.13039/100000001","funderIdentifierType":"Crossref Funder ID","schemeUri":"https://doi.org/10.13039"' ELSE '' END, '}]') AS funding FROM documents"""


def link_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = inputs.table(spark, sf_dir, "pages").select("page_id", identifiers.page_links(F.col("html")).alias("links"))
    related = identifiers.related_links(F.col("links"), F.array(F.lit("/the")))
    return pages.select("page_id", F.size("links").cast("long").alias("n_links"), F.size(related).cast("long").alias("n_related"), F.array_join(F.array_sort("links"), " ").alias("links"))


LINKS = """
    SELECT page_id, len(l)::BIGINT AS n_links, len(list_filter(l, lambda x: NOT regexp_matches(x, '(?i)^mailto:|creativecommons\\.org|opensource\\.org/licenses|spdx\\.org|orcid\\.org|doi\\.org|arxiv\\.org|ror\\.org|isni\\.org|grid\\.ac') AND lower(x) <> '/the'))::BIGINT AS n_related,
        array_to_string(list_sort(l), ' ') AS links
    FROM (SELECT page_id, list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS l FROM pages)"""


def license_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matched(inputs.documents(spark, sf_dir, f"{inputs.RIGHTS} AS rights"), "rights").select("doc_id", "rights", "spdx")


def _aliases() -> tuple[str, str]:
    import re

    by_key = {re.sub("[^a-z0-9]", "", a.lower()): s for s, _, _, names in fixed.LICENSES for a in names}
    near: dict[tuple[str, str], str] = {}
    for s, _, _, names in fixed.LICENSES:
        for a in names:
            near.setdefault((",".join(str(int(x)) for x in re.findall(r"\d+", a)), re.sub("[^a-z]", "", a.lower())), s)
    return ", ".join(f"('{k}', '{v}')" for k, v in by_key.items()), ", ".join(f"('{i}', '{a}', '{s}')" for (i, a), s in near.items())


LICENSES = f"""
    WITH d AS (SELECT doc_id, {inputs.RIGHTS} AS rights FROM documents), t AS (
        SELECT DISTINCT rights, regexp_replace(lower(rights), '[^a-z0-9]', '', 'g') AS k, array_to_string(list_transform(regexp_extract_all(rights, '\\d+'), lambda x: x::INT), ',') AS ints, regexp_replace(lower(rights), '[^a-z]', '', 'g') AS alpha FROM d
    ), e AS (SELECT t.*, x.spdx FROM t LEFT JOIN (VALUES {_aliases()[0]}) AS x(k, spdx) USING (k)),
    n AS (SELECT rights, min(y.spdx) AS near FROM e JOIN (VALUES {_aliases()[1]}) AS y(ints, alpha, spdx) ON e.ints = y.ints AND levenshtein(e.alpha, y.alpha) <= 1 WHERE e.spdx IS NULL AND e.alpha <> '' GROUP BY rights HAVING count(DISTINCT y.spdx) = 1)
    SELECT doc_id, rights, coalesce(e.spdx, n.near) AS spdx FROM d JOIN e USING (rights) LEFT JOIN n USING (rights)"""


def rights_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "0 AS pos", f"{inputs.RIGHTS} AS rights", "CAST(NULL AS STRING) AS rightsIdentifier", "CAST(NULL AS STRING) AS rightsUri")
    return licenses.rights_entries(docs)


RIGHTS_ROWS = """
    WITH a(k, rights, id, uri, action) AS (VALUES (0, 'Creative Commons Attribution 4.0 International', 'CC-BY-4.0', 'https://creativecommons.org/licenses/by/4.0/', 'match'), (1, 'Apache License 2.0', 'Apache-2.0', 'https://www.apache.org/licenses/LICENSE-2.0', 'match'),
        (2, 'MIT License', 'MIT', 'https://opensource.org/licenses/MIT', 'match'), (3, 'Creative Commons Attribution-NonCommercial 4.0 International', 'CC-BY-NC-4.0', 'https://creativecommons.org/licenses/by-nc/4.0/', 'match'), (4, 'GNU General Public License, version 3', NULL, NULL, 'keep'),
        (5, 'Creative Commons Attribution 4.0 International', 'CC-BY-4.0', 'https://creativecommons.org/licenses/by/4.0/', 'match'), (6, 'BSD 3-Clause "New" or "Revised" License', 'BSD-3-Clause', 'https://opensource.org/licenses/BSD-3-Clause', 'match'), (7, 'Creative Commons Zero 1.0 Universal', 'CC0-1.0', 'https://creativecommons.org/publicdomain/zero/1.0/', 'match'),
        (8, 'Creative Commons Attribution-ShareAlike 4.0 International', 'CC-BY-SA-4.0', 'https://creativecommons.org/licenses/by-sa/4.0/', 'url'), (9, 'All Rights Reserved', NULL, NULL, 'known'), (10, 'License', NULL, NULL, 'drop'), (11, 'house rules', NULL, NULL, 'keep'))
    SELECT doc_id, 0 AS pos, rights, id AS "rightsIdentifier", CASE WHEN id IS NOT NULL THEN 'SPDX' END AS "rightsIdentifierScheme", CASE WHEN id IS NOT NULL THEN 'https://spdx.org/licenses/' END AS "schemeUri", uri AS "rightsUri", action FROM documents JOIN a ON doc_id % 12 = k"""


def titles_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "substr(split(text, chr(10))[0], 1, 60) AS title", "CASE doc_id % 3 WHEN 0 THEN upper(substr(split(text, chr(10))[0], 1, 90)) WHEN 1 THEN 'Quite Another Heading Here' ELSE 'Short' END AS candidate", "text")
    return lines.grounded_title(docs).select("doc_id", "action", "new_title")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.documents(spark, sf_dir, "text").select("doc_id", language.gate(F.col("text")).alias("gate"), language.language(F.col("text")).alias("language"))


def language_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.documents(spark, sf_dir, "text").select("doc_id", language.gate(F.col("text")).alias("gate"))


GATES = r"SELECT doc_id, length(text) >= 200 OR length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) >= 50 AS gate FROM documents"


def capture_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, numbers and length of the first half of each text against the whole."""
    docs = inputs.documents(spark, sf_dir, "concat(text, ' 12 and 3.5') AS ref", "concat(substr(text, 1, CAST(length(text) / 2 AS INT)), ' 12') AS got")
    r, g = F.col("ref"), F.col("got")
    return docs.select("doc_id", F.round(metrics.word_capture(r, g), 6).alias("words"), F.round(metrics.number_capture(r, g), 6).alias("numbers"), F.round(metrics.field_proportion(r, g), 6).alias("fields"))


METRICS = rf"""
    WITH d AS (SELECT doc_id, concat(text, ' 12 and 3.5') AS ref, concat(substr(text, 1, CAST(floor(length(text) / 2) AS INT)), ' 12') AS got FROM documents),
    t AS (SELECT *, list_distinct(regexp_extract_all(lower(ref), {T})) AS a, list_distinct(regexp_extract_all(lower(got), {T})) AS b, regexp_extract_all(ref, '\d+\.?\d*') AS m, regexp_extract_all(got, '\d+\.?\d*') AS n FROM d),
    u AS (SELECT *, list_distinct(list_concat(m, list_transform(list_filter(m, lambda x: contains(x, '.')), lambda x: split_part(x, '.', 1)))) AS mm, list_distinct(list_concat(n, list_transform(list_filter(n, lambda x: contains(x, '.')), lambda x: split_part(x, '.', 1)))) AS nn FROM t)
    SELECT doc_id, round(len(list_intersect(a, b))::DOUBLE / len(a), 6) AS words, round(len(list_intersect(mm, nn))::DOUBLE / len(mm), 6) AS numbers, round(length(got)::DOUBLE / length(ref), 6) AS fields FROM u"""


def rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts against themselves without every seventh word and with every eleventh replaced."""
    docs = inputs.documents(spark, sf_dir, "text AS ref", "array_join(transform(filter(split(text, ' '), (w, i) -> i % 7 <> 3), (w, i) -> CASE WHEN i % 11 = 5 THEN 'other' ELSE w END), ' ') AS got")
    return docs.select("doc_id", F.round(metrics.rouge_l(F.col("ref"), F.col("got")), 6).alias("rouge_l"))


def unicode_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "concat('“', substr(text, 1, 40), '” ﬁn​ ½ – ', text) AS t")
    return docs.select("doc_id", *[F.md5(f("t").cast("binary")).alias(n) for n, f in (("normalized", text.normalized), ("cleaned", text.cleaned), ("for_model", text.for_model), ("marked", text.right_to_left_marked), ("valid", text.valid_utf8))])


def plain_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "concat('# **', text, '** __x__, Spain') AS t")
    return docs.select("doc_id", text.alphanumeric("t").alias("alphanumeric"), text.without_markdown("t").alias("plain"), text.without_country("t").alias("place"), text.alnum_key("t").alias("key"))


FORMS = r"""
    WITH d AS (SELECT doc_id, concat('# **', text, '** __x__, Spain') AS t FROM documents)
    SELECT doc_id, lower(trim(regexp_replace(regexp_replace(t, '[^a-zA-Z0-9\s]', '', 'g'), '\s+', ' ', 'g'))) AS alphanumeric,
        trim(regexp_replace(regexp_replace(regexp_replace(t, '\*\*([^*]+)\*\*', '\1', 'g'), '__([^_]+)__', '\1', 'g'), '(?m)^\s{0,3}#{1,6}\s+', '', 'g'), chr(10) || chr(9) || chr(13) || ' ') AS plain,
        trim(regexp_replace(t, ',[^,]*$', '')) AS place, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS key FROM d"""


def runaway_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir, "array(length(text), CAST(doc_id % 50 AS INT), 10) AS lengths", "CAST(3 + doc_id % 4 AS INT) AS heads", "length(text) AS raw", "doc_id % 5 = 0 AS capped", "doc_id % 7 = 0 AS failed")
    s = records.runaway(F.col("lengths"), F.col("heads"), F.col("raw"), F.col("capped"), F.col("failed"))
    return docs.select("doc_id", F.array_join(s["reasons"], ",").alias("reasons"), F.round(s["score"], 6).alias("score"))


RUNAWAY = """
    WITH d AS (SELECT doc_id, length(text)::DOUBLE AS raw, greatest(length(text), doc_id % 50, 10)::DOUBLE AS big, (length(text) + doc_id % 50 + 10)::DOUBLE AS total, 3 + doc_id % 4 AS heads FROM documents),
    f AS (SELECT doc_id, doc_id % 7 = 0 AS failed, doc_id % 5 = 0 AS capped, big / total > 0.7 AND heads >= 5 AS one, CASE WHEN raw > 0 THEN total / raw ELSE 0 END > 1.6 AS more, big / total AS share, CASE WHEN raw > 0 THEN total / raw ELSE 0 END AS ratio FROM d)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN failed THEN 'error' END, CASE WHEN capped THEN 'capped' END, CASE WHEN one THEN 'one section' END, CASE WHEN more THEN 'longer than text' END], lambda x: x IS NOT NULL), ',') AS reasons,
        round(CASE WHEN failed THEN 10.0::DOUBLE ELSE 0 END + CASE WHEN capped THEN 2 ELSE 0 END + CASE WHEN one THEN share ELSE 0 END + CASE WHEN more THEN ratio ELSE 0 END, 6) AS score FROM f"""

QUERIES = {
    "sections": sections, "line_runs": line_runs, "collapsed_repeats": collapsed_repeats, "ocr_headers": ocr_headers, "inline_splits": inline_splits, "normalised_duplicates": normalised_duplicates, "numerals": numerals, "tokens": tokens,
    "shingle_coverage": shingle_coverage, "uncaptured_lines": uncaptured_lines, "predicates": predicates, "caption_labels": caption_labels, "merged_captions": merged_captions, "caption_spans": caption_spans, "identifiers_found": identifiers_found,
    "identifier_schemes": identifier_schemes, "identifiers_placed": identifiers_placed, "link_annotations": link_annotations, "license_matches": license_matches, "rights_lists": rights_lists, "titles_grounded": titles_grounded, "languages": languages,
    "language_gates": language_gates, "capture_metrics": capture_metrics, "rouge": rouge, "unicode_forms": unicode_forms, "plain_forms": plain_forms, "runaway_scores": runaway_scores,
}
ORACLE_SQL = {
    "identifiers_placed": PLACED, "rights_lists": RIGHTS_ROWS,
    "sections": SECTIONS, "line_runs": LINE_RUNS, "normalised_duplicates": DUPLICATES, "numerals": NUMERALS, "tokens": TOKENS, "shingle_coverage": COVERAGE, "predicates": PREDICATES, "caption_labels": CAPTIONS, "identifiers_found": IDENTIFIERS,
    "identifier_schemes": SCHEMES, "link_annotations": LINKS, "license_matches": LICENSES, "language_gates": GATES, "capture_metrics": METRICS, "plain_forms": FORMS, "runaway_scores": RUNAWAY,
}

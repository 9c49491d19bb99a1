"""The ladder of attempts against a plain loop, each document asked no more often than needed; the layout fallback; captions, title and links of files."""

import json

from pyspark.sql import functions as F

from lectern import session
from lectern.operators import attempts, records
from lectern.plans import drawn_queries as queries, files
from lectern.sources.adapters import GLYPHS, OBJECTS, Options

DOCS = [(1, "short", None), (2, "a longer text of some words", "Captions are marked."), (3, "cut off", None), (4, "never", None), (5, "word " * 300, None), (6, None, None), (7, "silent", None), (8, "list", None)]
LADDER = (attempts.Attempt(attempts.FULL, 20), attempts.Attempt(attempts.FULL, 40, "Be brief."), attempts.Attempt(attempts.SHORT, 40))


def answer(prompt, system, tokens):
    """A plain model: (response, capped), or None for no answer."""
    body = prompt.split("TEXT:\n")[1].split("\n\nJSON:")[0]
    if body == "silent":
        return None
    if body == "never" or (body == "list" and tokens == 20):
        return ("nothing", False)
    if body == "list":
        return ('[1, {"a": 2}]', False)
    if body == "cut off":
        return ('{"titles": [{"title": "Dep', True)
    if len(body) > tokens or (body.startswith("a longer") and not prompt.startswith(attempts.SHORT[:10])):
        return ("Sure! Here it comes", True)
    return (json.dumps({"t": body, "note": "Captions are marked." in prompt, "system": system}), False)


def plain_ladder():
    out = {}
    for i, t, note in DOCS:
        t = t or ""
        if sum(-(-len(w) // 4) for w in t.split()) > 200:
            out[i] = (None, 0, attempts.TOO_LONG)
            continue
        got = None
        for n, a in enumerate(LADDER, 1):
            prompt = (a.prompt if not note else a.prompt.replace("TEXT:", note + "\n\nTEXT:")).replace("{text}", t)
            said = answer(prompt, a.system, a.tokens)
            got = records.repaired(said[0]) if said else None
            if got is not None:
                break
        out[i] = (got, n, None if got is not None else attempts.NO_JSON)
    return out


def test_ladder_equals_a_plain_loop(spark):
    asked = []

    def model(prompts):
        rows = prompts.collect()
        asked.append(sorted(r.doc_id for r in rows))
        got = [(r.doc_id, *said) for r in rows if (said := answer(r.prompt, r.system, r.tokens))]
        return prompts.sparkSession.createDataFrame(got, "doc_id long, response string, capped boolean")

    docs = spark.createDataFrame(DOCS, "doc_id long, text string, note string").withColumns({"json": F.lit("clash"), "attempt": F.lit(9)})
    got, every = attempts.attempted(docs, model, LADDER, most_input=200)
    assert {r.doc_id: (r.json, r.attempts, r.error_code) for r in got.collect()} == plain_ladder()
    assert asked == [[1, 2, 3, 4, 6, 7, 8], [2, 4, 7, 8], [2, 4, 7]] and every.groupBy("doc_id", "attempt").count().where("count > 1").count() == 0
    cut = {r.doc_id: (r.capped, r.truncated) for r in got.collect()}
    assert cut[3] == (True, True) and cut[1] == (False, False)
    assert attempts.attempted(docs.limit(0), model, LADDER)[0].count() == 0


def test_fallback_reads_runaway_documents_only(spark):
    heads = "\n".join(f"## Part {i}\nshort text" for i in range(6))
    texts = [(1, heads), (2, heads + " " + "very long " * 200), (3, "same " * 50), (4, "no answer"), (5, heads + " " + "very long " * 90), (6, None)]
    seen = []

    def structure(docs):
        part = F.filter(F.split("text", "(?m)^## "), lambda s: s != "")
        said = F.to_json(F.struct(F.struct(F.transform(part, lambda s: F.struct(s.alias("sectionContent"))).alias("sections")).alias("content")))
        return docs.select("doc_id", F.when(F.col("text") != "no answer", said).alias("response"), (F.col("doc_id") == 3).alias("capped"))

    def other(ids):
        seen.append(sorted(r.doc_id for r in ids.collect()))
        rows = [(2, heads + "\n## Part 7\n" + "very long " * 20), (3, "same " * 50), (4, "an answer"), (5, heads + " " + "very long " * 400)]
        return ids.join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")

    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in attempts.with_fallback(df, structure, other).collect()}
    assert seen == [[2, 3, 4, 5, 6]]  # the sixth has no text, so no answer
    assert {i: r.engine for i, r in got.items()} == {1: "first", 2: "second", 3: "first", 4: "second", 5: "first", 6: "first"}
    assert got[2].reasons == [] and got[3].reasons == ["capped"] and got[4].score == 0 and got[5].score < 1 and got[1].reasons == []
    assert attempts.with_fallback(df.limit(0), structure, other).count() == 0


def test_fallback_joins_counts_and_not_texts(spark, monkeypatch):
    """Only what other() gives meets ids with its text; answers stay where they were written."""
    joined = []

    def columns(plan):
        for i in range(plan.children().size()):
            child = plan.children().apply(i)
            if plan.nodeName() == "Join":
                joined.append({child.output().apply(k).name() for k in range(child.output().size())})
            columns(child)

    def watched(df, *args):
        columns(df._jdf.queryExecution().optimizedPlan())
        return session.written(df, *args)

    monkeypatch.setattr(attempts, "written", watched)
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("## a\nb\n"), 6), F.repeat(F.lit("long "), 200), F.col("id").cast("string")).alias("text"))
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("## c\nwords "), (F.col("id") % 10).cast("string"), F.lit("\n")), 9).alias("text"))
    got = attempts.with_fallback(texts, queries._pieces, lambda ids: rows.join(ids, "doc_id", "left_semi"))
    assert sum("text" in x for x in joined) == 2 and not any("response" in x for x in joined)
    assert {(r.engine, r.n_chars, len(r.text)) for r in got.collect()} == {("second", 117, 117)}


def test_sizes_of_sections_are_those_of_the_repaired_json(spark):
    """By Python where the sections are plain, by the JSON otherwise: the same sizes."""
    body = ['{"content":{"sections":[{"sectionContent":"a\U0001f600é"},{"sectionContent":""}]}}', '{"content":{"sections":[{"sectionContent":null},{"sectionContent":"ab"}]}}', '{"content":{"sections":[]}}', '{"content":{"sections":[{}]}}', '{"content":{"sections":[null]}}']
    body += ['{"posterContent":{"sections":[{"sectionContent":"abc"}]}}', '{"content":{},"posterContent":{"sections":[{"sectionContent":"abc"}]}}', '{"content":"x"}', '{"content":{"sections":"x"}}', '{"content":{"sections":[{"sectionContent":5}]}}', '{"content":{"sections":[{"sectionContent":["a"]}]}}']
    body += ['[1, {"content":{"sections":[{"sectionContent":"ab"}]}}]', '```json\n{"content":{"sections":[{"sectionContent":"ab"}]}}\n```', '{"content":{"sections":[{"sectionContent":"a "b" c"}', "{}", "none", "", None]
    df = spark.createDataFrame(list(enumerate(body)), "doc_id int, response string")
    r = F.from_json(records.repaired_json("response"), attempts._CONTENT)
    sizes = F.transform(F.coalesce(r["content"]["sections"], r["posterContent"]["sections"]), lambda s: F.length(F.coalesce(s["sectionContent"], F.lit(""))))
    want = {x.doc_id: (x.sizes, x.failed) for x in df.select("doc_id", sizes.alias("sizes"), records.repaired_json("response").isNull().alias("failed")).collect()}
    assert {x.doc_id: (x.sizes, x.failed) for x in attempts._said(df).collect()} == want and want[0][0] == [3, 0]
    lone = spark.createDataFrame([(0, '{"content":{"sections":[{"sectionContent":"a\\ud800"}]}}')], "doc_id int, response string")
    assert [x.sizes for x in attempts._said(lone).collect()] == [[2]]  # half a character: has no bytes of its own, and stopped the job


LINES = [("Depth of the River in Spring", 20, 40, 24, True), ("Methods", 20, 130, 10, True), ("we measured the depth of the river twice a day in the village", 20, 142, 10, False), ("and wrote it down in the parish book for all who came by", 20, 154, 10, False), ("the river rose by day and fell by night in every week", 20, 416, 9, False), ("Table 2. Boats by town and year", 20, 600, 9, False), ("Results", 20, 700, 10, True), ("the boats were all back in the autumn of the same year", 20, 712, 10, False)]


def drawn(found):
    rows = found.sparkSession.createDataFrame([(i, t, float(x), float(y), float(s), b) for i, (t, x, y, s, b) in enumerate(LINES)], "line int, t string, x double, y double, s double, b boolean")
    chars = rows.select("line", "x", "y", "s", "b", F.posexplode(F.split("t", "")).alias("i", "text")).where("text != ''")
    glyphs = found.select("path").crossJoin(chars).selectExpr("path", "1 AS page", "line * 1000 + i AS si", "text", "x + i * s / 2 AS x0", "x + i * s / 2 + s / 2 AS x1", "y - 0.75 * s AS top", "y + 0.25 * s AS bottom", "s AS size", "IF(b, 'Sans-Bold', 'Sans') AS fontname", "true AS upright", "CAST(NULL AS ARRAY<DOUBLE>) AS matrix", "600.0D AS page_w", "800.0D AS page_h", "CAST(NULL AS STRING) AS error")
    return glyphs.select(*[c.split()[0] for c in GLYPHS.split(", ")])


def objects(found):
    rows = [(1, "image", 20.0, 200.0, 260.0, 400.0, None), (1, "link", 1.0, 2.0, 3.0, 4.0, "https://example.org/a"), (1, "link", 1.0, 3.0, 3.0, 4.0, "https://example.org/b"), (1, "link", 9.0, 9.0, 9.0, 9.0, "https://example.org/a")]
    return found.select("path").crossJoin(found.sparkSession.createDataFrame(rows, ", ".join(OBJECTS.split(", ")[1:]))).select(*[c.split()[0] for c in OBJECTS.split(", ")])


def test_captions_title_and_links_of_files(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.pdf").write_bytes(b"%PDF")
    options = Options(glyphs=drawn, objects=objects, extract_identifiers=True)
    got = files.records(spark, str(tmp_path), options=options).collect()
    assert len(got) == 2
    for r in got:
        record = json.loads(r.json)
        assert record["titles"] == [{"title": "Depth of the River in Spring"}] and r.text_source == "layout"
        assert [c["caption"] for c in record["imageCaptions"]] == ["the river rose by day and fell by night in every week"]
        assert [c["caption"] for c in record["tableCaptions"]] == ["Table 2. Boats by town and year"]
        assert [x["relatedIdentifier"] for x in record["relatedIdentifiers"]] == ["https://example.org/a", "https://example.org/b"]
        assert "the river rose" not in json.dumps(record["content"]) and "Methods" in json.dumps(record["content"])


def test_second_engine_of_files(spark, tmp_path):
    """The structurer runs away on the first text only; the record is that of the second engine."""
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    calls = []

    def structure(docs):
        calls.append(docs.count())
        said = '{"titles": [{"title": "Kept"}], "content": {"sections": [{"sectionTitle": "All", "sectionContent": "the second answer"}]}}'
        return docs.select("doc_id", F.when(F.lit(len(calls) > 1), said).alias("response"))

    got = files.records(spark, str(tmp_path), options=Options(glyphs=drawn, objects=objects, structurer=structure)).collect()[0]
    assert calls == [1, 1] and got.text_source == "second layout" and "the second answer" in got.json

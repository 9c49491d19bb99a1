"""Queries of attempts, of the layout fallback and of drawn files, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import attempts, pages, stream
from lectern.plans import files, inputs
from lectern.sources.adapters import GLYPHS, OBJECTS, Options

#: Characters of an answer in the ladder's attempts, and pieces of the longest text.
FEW, MORE, MOST = 300, 2_000, 1_500
LADDER = (attempts.Attempt(attempts.FULL, FEW), attempts.Attempt(attempts.FULL, MORE), attempts.Attempt(attempts.SHORT, MORE))


def _echo(asked: DataFrame) -> DataFrame:
    """Stands for a model: answers with the text as one section if that has no more characters than tokens; to the short prompt, unless three divides the number of characters."""
    body = F.regexp_extract("prompt", r"(?s)TEXT:\n(.*)\n\nJSON:\z", 1)
    whole = F.to_json(F.struct(F.struct(F.array(F.struct(body.alias("sectionContent"))).alias("sections")).alias("content")))
    short = F.col("prompt").startswith(attempts.SHORT[:20]) & (F.length(body) % 3 != 0)
    return asked.select("doc_id", F.when((F.length(body) <= F.col("tokens")) | short, whole).otherwise("There is no record.").alias("response"), (F.length(body) > F.col("tokens")).alias("capped"))


def attempt_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through three attempts; only those without an answer go on."""
    answers, every = attempts.attempted(inputs.documents(spark, sf_dir, "text"), _echo, LADDER, most_input=MOST)
    asked = every.groupBy("doc_id").agg(F.count(F.lit(1)).alias("asked"))
    content = F.length(F.get_json_object("json", "$.content.sections[0].sectionContent"))
    return answers.join(asked, "doc_id", "left").select("doc_id", F.col("attempts").cast("long").alias("attempts"), F.coalesce("asked", F.lit(0)).cast("long").alias("asked"), "error_code", "capped", content.cast("long").alias("n_chars"))


ATTEMPTS = f"""
    WITH t AS (SELECT doc_id, strip_accents(coalesce(text, '')) AS t FROM documents),
    s AS (SELECT doc_id, length(t) AS n, len(regexp_extract_all(t, '\\p{{L}}{{1,4}}|\\p{{N}}|[^\\s\\p{{L}}\\p{{N}}]')) AS pieces FROM t),
    a AS (SELECT doc_id, n, CASE WHEN pieces > {MOST} THEN 0 WHEN n <= {FEW} THEN 1 WHEN n <= {MORE} THEN 2 ELSE 3 END::BIGINT AS attempts, n > {MORE} AND n % 3 = 0 AS none FROM s)
    SELECT doc_id, attempts, attempts AS asked, CASE WHEN attempts = 0 THEN 'INPUT_TOO_LONG' WHEN none THEN 'NO_JSON' END AS error_code, attempts = 3 AS capped,
        CASE WHEN attempts > 0 AND NOT none THEN n END::BIGINT AS n_chars FROM a"""


def _with_headers(which: Column | str, header) -> Column:
    rows = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    return F.array_join(F.transform(rows, lambda line, i: F.when(header(i), F.concat(F.lit("## "), line)).otherwise(line)), "\n").alias(which)


def _pieces(docs: DataFrame) -> DataFrame:
    """doc_id, response: each header with what follows it as a section."""
    parts = F.filter(F.split("text", "(?m)^## "), lambda s: s != "")
    return docs.select("doc_id", F.to_json(F.struct(F.struct(F.transform(parts, lambda s: F.struct(s.alias("sectionContent"))).alias("sections")).alias("content"))).alias("response"))


def layout_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts whose first six lines are headers, so that one section holds nearly all; the other engine heads each third line."""
    docs = inputs.documents(spark, sf_dir, "text")
    first = docs.select("doc_id", _with_headers("text", lambda i: i < 6))

    def other(ids: DataFrame) -> DataFrame:
        return docs.join(ids, "doc_id", "left_semi").select("doc_id", _with_headers("text", lambda i: i % 3 == 0))

    got = attempts.with_fallback(first, _pieces, other)
    return got.select("doc_id", "engine", F.round("score", 6).alias("score"), F.col("n_chars").cast("long").alias("n_chars"), F.array_join("reasons", ",").alias("reasons"))


FALLBACK = """
    WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    t AS (
        SELECT doc_id, array_to_string(list_transform(l, lambda x, i: CASE WHEN i <= 6 THEN '## ' || x ELSE x END), chr(10)) AS t1,
            array_to_string(list_transform(l, lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN '## ' || x ELSE x END), chr(10)) AS t2 FROM l
    ), u AS (SELECT doc_id, 1 AS k, t1 AS t FROM t UNION ALL SELECT doc_id, 2, t2 FROM t),
    s AS (
        SELECT doc_id, k, t, len(regexp_extract_all(t, '(?m)^## ')) AS heads, list_transform(list_filter(regexp_split_to_array(t, '(?m)^## '), lambda x: x <> ''), lambda x: length(x)) AS n FROM u
    ), r AS (
        SELECT doc_id, k, t, CASE WHEN heads >= 5 AND coalesce(list_sum(n), 0) > 0 AND list_max(n) / list_sum(n)::DOUBLE > 0.7::DOUBLE THEN list_max(n) / list_sum(n)::DOUBLE ELSE 0 END AS score FROM s
    ), b AS (
        SELECT a.doc_id, CASE WHEN a.score > 0 AND a.t <> b.t AND b.t <> '' AND b.score < a.score THEN 2 ELSE 1 END AS k FROM r AS a JOIN r AS b ON a.doc_id = b.doc_id AND a.k = 1 AND b.k = 2
    )
    SELECT r.doc_id, CASE r.k WHEN 1 THEN 'first' ELSE 'second' END AS engine, round(r.score, 6) AS score, length(r.t)::BIGINT AS n_chars, CASE WHEN r.score > 0 THEN 'one section' ELSE '' END AS reasons
    FROM b JOIN r ON b.doc_id = r.doc_id AND b.k = r.k"""

#: Words of a turn without marks; a title takes the first of those of four letters or more.
PLAIN = "regexp_extract_all(lower(coalesce(text, '')), '[a-zà-öø-ÿ]+', 0)"
LINE, LEADING = 90, 12


def _drawn(conversations: DataFrame) -> DataFrame:
    """A page for each conversation, word by word: the title in 24 points, then each turn under a bold header, and under each answer a caption; doc_id, si, text, x0, top, size, bold."""
    turns = conversations.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", F.expr(PLAIN).alias("words"))
    title = turns.where("turn = 0").select("conv_id", F.lit(-1).alias("turn"), F.slice(F.filter("words", lambda w: F.length(w) >= 4), 1, 6).alias("words"), F.lit(0).alias("part"), F.lit(24.0).alias("size"), F.lit(True).alias("bold"))
    head = turns.select("conv_id", "turn", F.array(F.lit("Part"), (F.col("turn") + 1).cast("string")).alias("words"), F.lit(0).alias("part"), F.lit(10.0).alias("size"), F.lit(True).alias("bold"))
    body = turns.select("conv_id", "turn", "words", F.lit(1).alias("part"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"))
    caption = turns.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.array(F.lit("Figure"), F.concat((F.col("turn") + 1).cast("string"), F.lit("."))), F.slice("words", 1, 8)).alias("words"), F.lit(2).alias("part"), F.lit(9.0).alias("size"), F.lit(False).alias("bold"))
    every = title.unionByName(head).unionByName(body).unionByName(caption)
    starts = F.aggregate("words", F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(w) + 1)))
    return every.withColumn("at", starts).select("conv_id", "turn", "part", "size", "bold", F.posexplode(F.arrays_zip("words", F.slice("at", F.lit(1), F.size("words")).alias("at"))).alias("i", "w")).select("conv_id", "turn", "part", "size", "bold", "i", "w.words", "w.at")


def drawn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations drawn as pages, read back by the file plan: title, captions and sections of each record."""
    talks = inputs.table(spark, sf_dir, "conversations")
    words = _drawn(talks)
    # A turn is 20 lines high at least, and as high as its text: 2,000 characters are 23 lines.
    y = F.when(F.col("turn") < 0, 40).otherwise(150 + F.col("turn") * 1_000 + F.col("part") * 30 + F.when(F.col("part") == 2, 800).otherwise(0)) + F.floor(F.col("at") / LINE) * LEADING
    x = 20 + F.pmod("at", F.lit(LINE)) * F.col("size") / 2
    placed = words.select(F.concat(F.lit("/talks/"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("path"), "turn", "part", "i", "words", "size", "bold", x.cast("double").alias("x"), y.cast("double").alias("y"))

    def glyphs(found: DataFrame) -> DataFrame:
        drawn = placed.selectExpr(
            "path", "1 AS page", "CAST((turn + 1) * 100000 + part * 30000 + i AS INT) AS si", "words AS text", "x AS x0", "x + length(words) * size / 2 AS x1", "y - 0.75D * size AS top", "y + 0.25D * size AS bottom", "CAST(size AS DOUBLE) AS size",
            "IF(bold, 'Sans-Bold', 'Sans') AS fontname", "true AS upright", "CAST(NULL AS ARRAY<DOUBLE>) AS matrix", "1400.0D AS page_w", "40000.0D AS page_h", "CAST(NULL AS STRING) AS error",
        )
        return drawn.select(*[c.split()[0] for c in GLYPHS.split(", ")])

    options = Options(glyphs=glyphs, objects=lambda found: spark.createDataFrame([], OBJECTS), plain=lambda found: found.select("path", F.lit(None).cast("string").alias("plain_text")))
    found = talks.where("conv_id is not null").select(F.concat(F.lit("/talks/"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("path")).distinct().withColumns({"kind": F.lit("pdf"), "media": F.lit("application/pdf"), "content": F.lit(b"")})
    made = files.recorded(found, options)
    r = F.from_json("json", "titles array<struct<title:string>>, imageCaptions array<struct<caption:string>>, content struct<sections:array<struct<sectionTitle:string>>>")
    x = made.select(F.regexp_extract("path", r"(\d+)\.pdf", 1).cast("long").alias("conv_id"), r.alias("r"))
    return x.select("conv_id", F.col("r.titles")[0]["title"].alias("title"), F.array_join("r.imageCaptions.caption", "|").alias("captions"), F.size(F.filter("r.content.sections", lambda s: s["sectionTitle"].rlike("^Part \\d+$"))).cast("long").alias("n_parts"))


DRAWN = """
    WITH t AS (SELECT conv_id, turn, role, regexp_extract_all(lower(coalesce(text, '')), '[a-zà-öø-ÿ]+') AS w FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
    SELECT conv_id, max(CASE WHEN turn = 0 THEN array_to_string(list_filter(w, lambda x: length(x) >= 4)[1:6], ' ') END) AS title,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN 'Figure ' || (turn + 1) || '. ' || array_to_string(w[1:8], ' ') END, '|' ORDER BY turn), '') AS captions, count(*)::BIGINT AS n_parts FROM t GROUP BY conv_id"""

#: Letters 0.7 of a size apart, words 1.4.
STEP, APART = 7.0, 14.0


def spaced_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations drawn letter by letter, gaps between them and no blanks, and read back as words."""
    talks = inputs.table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn", F.expr(PLAIN).alias("words"))
    chars = talks.select("conv_id", "turn", F.posexplode("words").alias("w", "word")).select("conv_id", "turn", "w", F.posexplode(F.split("word", "")).alias("i", "text")).where("text != ''")
    order = Window.partitionBy("conv_id", "turn").orderBy("w", "i")
    x = F.lit(STEP) * (F.row_number().over(order) - 1) + F.lit(APART - STEP) * F.col("w")
    glyphs = chars.withColumns({"x0": x.cast("double"), "si": F.row_number().over(order)}).selectExpr(
        "conv_id AS doc_id", "CAST(turn AS INT) AS page", "si", "text", "x0", "x0 + 5 AS x1", "92.5D AS top", "102.5D AS bottom", "10.0D AS size", "'Serif' AS fontname", "1000000.0D AS page_w", "800.0D AS page_h"
    )
    return stream.read_stream(glyphs).select(F.col("doc_id").alias("conv_id"), F.col("page").cast("long").alias("turn"), "text", "engine")


SPACED = """
    WITH w AS (SELECT conv_id, turn::BIGINT AS turn, regexp_extract_all(lower(coalesce(text, '')), '[a-zà-öø-ÿ]+') AS w FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    n AS (SELECT *, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS c FROM w WHERE len(w) > 0)
    SELECT conv_id, turn, 'stream' AS engine, CASE WHEN c >= 6 AND n > 1 AND n < c AND (c - 2) // 4 < c - n THEN array_to_string(w, ' ')
        ELSE array_to_string(list_filter(string_split(array_to_string(w, ''), ''), lambda x: x <> ''), ' ') END AS text FROM n"""

def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the conversations as a box on the page of its turn, every third drawn again a little beside it, and every fifth again too far off to be the same."""
    talks = inputs.table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    words = talks.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.posexplode(F.expr(PLAIN)).alias("i", "text"))
    box = lambda no, shift: words.selectExpr("doc_id", "page", f"3 * i + {no} AS word_no", "text", f"10.0D * (i % 8) + {shift} AS x0", f"10.0D * (i % 8) + {shift} + 8 AS x1", "12.0D * (i div 8) AS top", "12.0D * (i div 8) + 10 AS bottom", "i")
    drawn = box(0, "0.0D").unionByName(box(1, "3.5D").where("i % 3 = 0")).unionByName(box(2, "200.0D").where("i % 5 = 0"))
    return pages.distinct_words(drawn.drop("i")).select(F.col("doc_id").alias("conv_id"), F.col("page").cast("long").alias("turn"), F.col("word_no").cast("long").alias("word_no"), "text")


# A word's neighbour is ten points on, so it never covers half of it, whatever its text.
REPEATED = """
    WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-zà-öø-ÿ]+') AS w FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    x AS (SELECT conv_id, turn, unnest(w) AS text, unnest(range(len(w))) AS i FROM w)
    SELECT conv_id, turn::BIGINT AS turn, 3 * i AS word_no, text FROM x UNION ALL SELECT conv_id, turn, 3 * i + 2, text FROM x WHERE i % 5 = 0"""

QUERIES = {"repeated_words": repeated_words, "spaced_letters": spaced_letters, "attempt_ladder": attempt_ladder, "layout_fallback": layout_fallback, "drawn_pages": drawn_pages}
ORACLE_SQL = {"repeated_words": REPEATED, "spaced_letters": SPACED, "attempt_ladder": ATTEMPTS, "layout_fallback": FALLBACK, "drawn_pages": DRAWN}
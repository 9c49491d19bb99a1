"""Each query with SQL against DuckDB on the smallest tables; the others run."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import registry

D = "/root/testdata/sf0.001"


def rows(columns, values):
    def plain(x):
        if isinstance(x, float):
            return None if x != x else float(f"{x:.10g}")
        return x

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(v[i]) for i in order]) for v in values)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, D)
    got = df.collect()
    if name not in registry.ORACLE_SQL:
        assert got
        return
    assert got  # SQL that agrees on no rows checks nothing
    want = db.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_region_words_of_all_parts(spark):
    """At sf0.01 there are 2,000 parts: all are regions, as in the SQL."""
    big = D.replace("0.001", "0.01")
    got = registry.QUERIES["region_words"](spark, big)
    want = duckdb.sql(registry.ORACLE_SQL["region_words"].replace("FROM lineitem", f"FROM '{big}/lineitem.parquet'").replace("FROM part", f"FROM '{big}/part.parquet'"))
    found = got.collect()
    assert rows(got.columns, found) == rows(want.columns, want.fetchall())
    assert max(r.region_id for r in found) > 1900 and any(r.table_like for r in found)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_in_blocks(monkeypatch):
    from lectern.operators import lines

    rng = random.Random(5)
    for bits in (1, 3, 64, 4096):
        monkeypatch.setattr(lines, "LCS_BITS", bits)
        for _ in range(150):
            a, b = (rng.choices("abcde"[: rng.randint(1, 5)], k=rng.randrange(40)) for _ in "ab")
            assert lines.lcs(a, b) == plain_lcs(a, b)
    a, b = (rng.choices([f"w{i}" for i in range(300)], k=20_000) for _ in "ab")
    assert 0 < lines.lcs(a, b) == lines.lcs(b, a)


def test_rouge_reads_whole_texts(spark, tmp_path):
    """A text far longer than 400 characters, against a plain LCS."""
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(["river", "depth", "the", "boat", "x1", "Été"], k=n))) for i, n in enumerate([0, 1, 30, 700])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in registry.QUERIES["rouge"](spark, str(tmp_path)).collect():
        a = docs[r.doc_id][1].lower().split()
        kept = [w for i, w in enumerate(docs[r.doc_id][1].split(" ")) if i % 7 != 3]
        b = " ".join("other" if i % 11 == 5 else w for i, w in enumerate(kept)).lower().split()
        want = 2 * plain_lcs(a, b) / (len(a) + len(b)) if a and b else 0.0
        assert abs(r.rouge_l - want) < 1e-6


def test_what_comes_late_in_a_text_is_read(spark, tmp_path):
    """Heads, captions, markdown and long lines beyond the characters that the queries once read."""
    long = "the depth of the river was measured " * 20
    docs = [(0, f"{long}\n{long}. FUNDING: none. TWINS — Our second sample"), (1, f"{long}\nFigure 4. Boats and more boats"), (2, f"{long}\n**bold** at the end\n" + "Boats of the Lower River")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def run(name):
        return registry.QUERIES[name](spark, str(tmp_path))

    assert {r.doc_id: r.n_parts for r in run("inline_splits").collect()} == {0: 6, 1: 4, 2: 4}
    assert {r.line_id: (r.kind, r.num, r.rest) for r in run("caption_labels").collect()}["1:1"] == ("table", "IV", "Figure 4. Boats and more boats")
    assert [r.line_id for r in run("predicates").where("header").collect()] == ["2:2"]
    assert all(len(r.alphanumeric) > 700 for r in run("plain_forms").collect())
    assert {r.doc_id: r.n_captions for r in run("merged_captions").collect()} == {0: 1, 1: 2, 2: 2}
    assert {r.doc_id: r.candidate for r in run("title_candidates").collect()}.get(0) is None
    from lectern.plans import record_queries

    assert {r.block_no: r.text for r in record_queries._blocks(spark, str(tmp_path)).collect()} == dict(docs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_of_documents(spark, tmp_path):
    from lectern.streaming import documents

    schema = "doc_id long, text string, ts timestamp"
    spark.createDataFrame([(1, "Same text"), (2, "same  TEXT"), (3, "other")], "doc_id long, text string").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS ts").write.parquet(str(tmp_path / "in"))
    stream = documents.once(documents.new_documents(spark, str(tmp_path / "in"), schema), "ts")
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2


def test_batch_of_files(spark, tmp_path):
    from lectern.sources import files

    for n in ("a.pdf", "b.PNG", "c.txt", "d.jpg"):
        (tmp_path / n).write_bytes(b"x")
    got = files.scan(spark, str(tmp_path), "*.pdf,*.jpg,*.pdf").collect()
    assert sorted((r.kind, r.media) for r in got) == [("image", "image/jpeg"), ("pdf", "application/pdf")]
    records = spark.createDataFrame([("a.pdf", 1, None)], "path string, year int, error string")
    files.write_batch(files.json_records(records, ["year", "error"]), str(tmp_path / "out"))
    assert files.read_records(spark, str(tmp_path / "out/records")).first().json.strip() == '{"year":1,"error":null}'
    assert spark.read.json(str(tmp_path / "out/results")).first().success


def test_retry_budget():
    from lectern.sources.adapters import Retry

    waits = []
    answers = iter([(503, None), (429, None), (200, "x")])
    assert Retry().get(lambda: next(answers), sleep=waits.append) == "x" and waits == [1.0, 2.0]
    assert Retry().get(lambda: (404, None), sleep=waits.append) is None and len(waits) == 2

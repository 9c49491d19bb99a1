"""Files to records: drawn pages, texts, files that cannot be read; the command line."""

import json

from pyspark.sql import functions as F

from lectern import cli
from lectern.plans import files
from lectern.sources.adapters import GLYPHS, Options

PAGE = [("Depth of the River in Spring", 20, 40, 20, True), ("Jane Doe, Max Roe", 20, 70, 10, False), ("University of Alder", 20, 90, 10, False), ("Methods", 20, 130, 10, True), ("We measured the depth of the river twice a day in the village", 20, 142, 10, False), ("and wrote it down in the parish book.", 20, 154, 10, False), ("Results", 20, 200, 10, True), ("The nets were dry all summer long and the boats stayed up by the road.", 20, 212, 10, False)]


def drawn(found):
    """Glyphs of a page for each file but those that are named damaged."""
    rows = found.sparkSession.createDataFrame([(i, t, float(x), float(y), float(s), b) for i, (t, x, y, s, b) in enumerate(PAGE)], "line int, t string, x double, y double, s double, b boolean")
    chars = rows.select("line", "x", "y", "s", "b", F.posexplode(F.split("t", "")).alias("i", "text")).where("text != ''")
    good = found.where("path not like '%damaged%'").select("path").crossJoin(chars)
    glyphs = good.selectExpr("path", "1 AS page", "line * 1000 + i AS si", "text", "x + i * s / 2 AS x0", "x + i * s / 2 + s / 2 AS x1", "y - 0.75 * s AS top", "y + 0.25 * s AS bottom", "s AS size", "IF(b, 'Sans-Bold', 'Sans') AS fontname", "true AS upright", "CAST(NULL AS ARRAY<DOUBLE>) AS matrix", "900.0D AS page_w", "800.0D AS page_h", "CAST(NULL AS STRING) AS error")
    bad = found.where("path like '%damaged%'").select("path", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in GLYPHS.split(", ")[1:-1]], F.lit("PDFSyntaxError: no trailer").alias("error"))
    return glyphs.select(*[c.split()[0] for c in GLYPHS.split(", ")]).unionByName(bad)


def test_records_of_files(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF"), ("damaged.pdf", b"%PDF"), ("b.txt", "# Boats\nAna Lima\n## Aims\nWe count the boats of every village by the river.".encode()), ("c.png", b"x"), ("d.csv", b"1")):
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.records(spark, str(tmp_path), options=Options(glyphs=drawn)).collect()}
    assert sorted(got) == ["a.pdf", "b.txt", "c.png", "damaged.pdf"]
    assert got["damaged.pdf"].error == "PDFSyntaxError: no trailer" and got["damaged.pdf"].json is None and got["c.png"].error == "no text could be read"
    record = json.loads(got["a.pdf"].json)
    assert record["titles"] == [{"title": "Depth of the River in Spring"}] and record["formats"] == ["application/pdf"] and got["a.pdf"].text_source == "layout"
    assert [s["sectionTitle"] for s in record["content"]["sections"] if "sectionTitle" in s][-2:] == ["Methods", "Results"]
    assert "twice a day in the village\nand wrote it down" in json.dumps(record["content"], ensure_ascii=False).replace("\\n", "\n")
    assert {"sectionTitle": "Aims", "sectionContent": "We count the boats of every village by the river."} in json.loads(got["b.txt"].json)["content"]["sections"] and got["b.txt"].report.valid


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_text("# Boats\nAna Lima\n## Aims\nWe count the boats of every village by the river.")
    (tmp_path / "in" / "empty.png").write_bytes(b"x")
    assert cli.main(["extract", str(tmp_path / "in" / "b.txt"), "--out", str(tmp_path / "b.json")]) == 0
    assert json.loads((tmp_path / "b.json").read_text())["titles"] == [{"title": "Boats"}]
    assert cli.main(["extract", str(tmp_path / "in" / "empty.png")]) == 1 and "no text" in capsys.readouterr().err
    assert cli.main(["batch", str(tmp_path / "in"), str(tmp_path / "out")]) == 1
    results = {r.file.rsplit("/", 1)[-1]: (r.success, r.error) for r in spark.read.json(str(tmp_path / "out" / "results")).collect()}
    assert results == {"b.txt": (True, None), "empty.png": (False, "no text could be read")}
    assert len([x for f in (tmp_path / "out" / "records").glob("*.txt") for x in f.read_text().splitlines()]) == 1
    assert cli.main(["validate", str(tmp_path / "b.json")]) == 0


def test_short_and_long_texts_without_another(spark):
    """A file whose only text is under or over the bounds keeps it; where there is another, that one is taken."""
    from lectern.sources import files as sources

    rows = [("pdf", "a few words", None, None, None), ("pdf", "x" * 30_001, None, None, None), ("pdf", "short", "y" * 200, None, None), ("pdf", "short", "plain", "seen", None), ("pdf", None, "plain", "", None), ("image", None, None, None, "cached"), ("pdf", "", None, "", None)]
    got = sources.raw_text(spark.createDataFrame(rows, "kind string, layout_text string, plain_text string, ocr_text string, cached_text string")).collect()
    assert [r.text_source for r in got] == ["layout", "layout", "plain", "ocr", "plain", "cached", None]
    assert got[0].text == "a few words" and len(got[1].text) == 30_001 and got[6].text is None


def test_short_drawn_pages_have_records(spark, tmp_path):
    from lectern.plans import drawn_queries

    rows = [(1, 0, "system", "Depth rivers nets of a boat."), (1, 1, "user", "We rowed over the river.")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = drawn_queries.drawn_pages(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(1, "depth rivers nets boat", "", 2)]

import random

import pandas as pd
from pyspark.sql import functions as F

from lectern.operators import layout, pages


def glyph(si, text, x, y, size=10.0, font="Sans", upright=True):
    return {"doc_id": 1, "page": 1, "si": si, "text": text, "x0": float(x), "x1": float(x) + size * 0.5, "top": float(y), "bottom": float(y) + size, "size": size, "fontname": font, "upright": upright}


def row(words, x, y, si, size=10.0):
    out = []
    for c in words:
        out.append(glyph(si + len(out), c, x, y, size))
        x += size * 0.5
    return out


def test_columns_are_read_one_after_the_other():
    page = []
    for i in range(6):
        page += row(f"left{i}", 50, 100 + 14 * i, len(page)) + row(f"right{i}", 350, 100 + 14 * i, len(page) + 100)
    got = pages.page_lines(pd.DataFrame(page)).text.tolist()
    assert got == [f"left{i}" for i in range(6)] + [f"right{i}" for i in range(6)]


def test_overprints_go_and_blanks_part_words():
    page = row("ab cd", 10, 10, 0) + row("ab", 10.2, 10.1, 50)
    assert pages.page_lines(pd.DataFrame(page)).text.tolist() == ["ab cd"]


def test_superscript_stays_on_its_line():
    page = row("Doe", 10, 20, 0) + [glyph(9, "1", 25.5, 18, 6.0)]
    assert pages.page_lines(pd.DataFrame(page)).text.tolist() == ["Doe 1"]


def test_vertical_text_is_kept_apart():
    page = row("flat text here", 10, 10, 0) + [glyph(50 + i, c, 300, 200 - 10 * i, upright=False) for i, c in enumerate("up")]
    assert pages.page_lines(pd.DataFrame(page)).text.tolist() == ["flat text here", "up"]


def test_damaged_glyphs_and_empty_pages():
    page = pd.DataFrame([*row("ok", 10, 10, 0), glyph(5, "(cid:3)", 40, 10), glyph(6, "x", float("nan"), 10)])
    assert pages.page_lines(page).text.tolist() == ["ok"]


def test_gaps_between_intervals(spark):
    rows = [(1, 0.0, 10.0), (1, 5.0, 8.0), (1, 20.0, 30.0), (2, 0.0, 1.0)]
    got = layout.gaps(spark.createDataFrame(rows, "doc_id long, a double, b double"), "a", "b", ("doc_id",)).collect()
    assert [(r.doc_id, r.mid, r.width) for r in got] == [(1, 15.0, 10.0)]


def test_hyphens_at_line_ends(spark):
    from pyspark.sql import functions as F

    join = lambda a, b, v: spark.range(1).select(layout.joined(F.array(F.lit(a), F.lit(b)), F.array(*map(F.lit, v))).alias("r")).first().r
    assert join("the informa-", "tion is", ["information"]) == "the information is"
    assert join("a long-", "term plan", ["long-term", "longterm"]) == "a long-term plan"
    assert join("no", "hyphen", ["x"]) == "no hyphen"


def test_clusters_of_shapes_are_masks():
    bars = [(100 + 12 * i, 100, 110 + 12 * i, 180) for i in range(5)]
    got = pages.masks([(300, 300, 400, 400)], [*bars, (0, 0, 600, 800)], 600, 800, 10.0)
    assert sorted(k for k, _ in got) == ["graphic", "image"]


def test_accents_and_right_to_left():
    assert pages.composed("´ecole") == "école"
    assert pages.logical(["םלוע", "םולש"]) == ["שלום", "עולם"]


def random_boxes(rng, n, most):
    out = []
    for i in range(n):
        x, y = rng.choice([0.0, 100.0, rng.uniform(0, 600)]), rng.choice([0.0, 50.0, rng.uniform(0, 800)])
        out.append((rng.randrange(3), 1, i, x, y, x + rng.choice([0.0, rng.uniform(0, most)]), y + rng.choice([0.0, 5.0, rng.uniform(0, most)])))
    return [*out, (0, 1, n, None, 1.0, 2.0, 3.0), (9, 1, n + 1, 0.0, 0.0, 1.0, 1.0)]


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(31)
    for most in (20, 700):
        a, b = random_boxes(rng, 60, most), random_boxes(rng, 80, most)
        names = "doc_id int, page int, {0} int, {0}x0 double, {0}y0 double, {0}x1 double, {0}y1 double"
        left, right = spark.createDataFrame(a, names.format("a")), spark.createDataFrame(b, names.format("b"))
        got = layout.near_pairs(left, right, layout.box("ax0", "ay0", "ax1", "ay1"), layout.box("bx0", "by0", "bx1", "by1"))
        want = sorted((p[0], p[2], q[2]) for p in a for q in b if p[0] == q[0] and None not in (*p, *q) and max(p[3], q[3]) <= min(p[5], q[5]) and max(p[4], q[4]) <= min(p[6], q[6]))
        assert sorted(map(tuple, got.select("doc_id", "a", "b").collect())) == want
        assert layout.near_pairs(left.limit(0), right, layout.box("ax0", "ay0", "ax1", "ay1"), layout.box("bx0", "by0", "bx1", "by1")).count() == 0


def test_pairs_in_cells_follow_the_overlaps(spark):
    """Boxes side by side: four times as many make about four times as many meetings, not sixteen times."""
    met = []
    for side in (12, 24, 48):
        n = side * side
        rows = spark.range(n).selectExpr("1 AS doc_id", "1 AS page", f"CAST(id % {side} * 10 AS DOUBLE) AS x", f"CAST(id div {side} * 10 AS DOUBLE) AS y")
        left, right = rows.selectExpr("doc_id", "page", "x AS ax", "y AS ay"), rows.selectExpr("doc_id", "page", "x AS bx", "y AS by")
        pairs, meet = layout._in_cells(left, right, layout.box("ax", "ay", F.col("ax") + 8, F.col("ay") + 8), layout.box("bx", "by", F.col("bx") + 8, F.col("by") + 8), ("doc_id", "page"))
        assert pairs.where(meet).count() == n
        met.append(pairs.count() / n)
    assert met[2] < 2 * met[0]


def test_long_pages_are_dealt_in_proportion(spark):
    """Boxes below each other on a page that grows in length: four times as many make about four times as many meetings, and none goes into more than a few cells."""
    met = []
    for n in (500, 2_000, 8_000):
        rows = spark.range(n).selectExpr("1 AS doc_id", "1 AS page", "CAST(id % 3 * 40 AS DOUBLE) AS x", "CAST(id * 100 AS DOUBLE) AS y")
        left, right = rows.selectExpr("doc_id", "page", "x AS ax", "y AS ay"), rows.selectExpr("doc_id", "page", "x AS bx", "y AS by")
        pairs, meet = layout._in_cells(left, right, layout.box("ax", "ay", F.col("ax") + 30, F.col("ay") + 10), layout.box("bx", "by", F.col("bx") + 60, F.col("by") + 40), ("doc_id", "page"))
        assert pairs.where(meet).count() == n
        met.append(pairs.count() / n)
    assert met[2] < 1.5 * met[0] and met[2] < 10


def test_side_labels_read_every_row_of_long_pages():
    from lectern.plans import record_queries

    assert record_queries.SIDE.count("doc_id % 50") == 3 and "floor(doc_id / 50)" in record_queries.SIDE


def test_captions_beside_and_panels_equal_all_pairs(spark):
    rng = random.Random(32)
    blocks = [(i % 2, 1, i, rng.choice(["word " * 30, "a short one"]), rng.uniform(0, 500), rng.uniform(0, 700), rng.uniform(20, 300), rng.uniform(8, 90), rng.choice([8.0, 10.0, 14.0])) for i in range(60)]
    regions = [(i % 2, 1, i, x := rng.uniform(0, 400), y := rng.uniform(0, 600), x + rng.uniform(20, 300), y + rng.uniform(20, 300)) for i in range(40)]
    b = spark.createDataFrame(blocks, "doc_id int, page int, block_no int, text string, hpos double, vpos double, width double, height double, fontsize double")
    r = spark.createDataFrame(regions, "doc_id int, page int, region_id int, x0 double, top double, x1 double, bottom double")

    def over(a0, a1, b0, b1):
        return max(0.0, min(a1, b1) - max(a0, b0))

    want_panels = sorted({(d, i) for d, _, i, x0, y0, x1, y1 in regions for e, _, _, t, x, y, w, h, s in blocks if d == e and len(t.split()) >= 25 and s >= 9 and over(x0, x1, x, x + w) * over(y0, y1, y, y + h) >= 0.8 * w * h})
    assert sorted((p.doc_id, p.region_id) for p in layout.panels(r, b, 10.0).collect()) == want_panels and want_panels
    want = {}
    for e, _, k, _, x, y, w, h, s in blocks:
        found = []
        for d, _, i, x0, y0, x1, y1 in regions:
            if d != e:
                continue
            wide, tall = over(x, x + w, x0, x1) / min(w, x1 - x0), over(y, y + h, y0, y1) / min(h, y1 - y0)
            gaps = [("below", y - y1, 2.5, wide >= 0.5), ("above", y0 - y - h, 2.5, wide >= 0.5), ("right", x - x1, 2.0, tall >= 0.6), ("left", x0 - x - w, 2.0, tall >= 0.6)]
            hit = next(((g, i, side) for side, g, most, ok in gaps if ok and -0.5 * s <= g <= most * s), None)
            found += [hit] if hit else []
        if found:
            g, i, side = min(found)
            want[k] = (i, side, round(g, 6))
    assert {p.block_no: (p.region_id, p.side, round(p.gap, 6)) for p in layout.beside(b, r).collect()} == want and want


def plain_distinct(words):
    kept = []
    for w in words:
        if not any(k[0] == w[0] and min(k[2], w[2]) - max(k[1], w[1]) >= 0.5 * min(k[2] - k[1], w[2] - w[1]) and min(k[4], w[4]) - max(k[3], w[3]) >= 0.5 * min(k[4] - k[3], w[4] - w[3]) for k in kept):
            kept.append(w)
    return kept


def test_repeated_words_equal_all_pairs():
    rng = random.Random(51)
    for _ in range(300):
        words = []
        for _ in range(rng.randrange(40)):
            x, y = rng.uniform(0, 60), rng.choice([0.0, 4.0, 12.0])
            words.append((rng.choice("ab"), x, x + rng.choice([0.0, 5.0, 12.0, 40.0]), y, y + rng.choice([8.0, 10.0])))
        found = pages.Repeats()
        assert [w for w in words if not found.repeats(*w)] == plain_distinct(words)


def test_shadows_are_read_once():
    glyph = lambda t, x, y, si: {"doc_id": 1, "page": 1, "si": si, "text": t, "x0": x, "x1": x + 5.0, "top": y, "bottom": y + 10.0, "size": 10.0, "fontname": "Sans", "upright": True}
    rows, si = [], 0
    for shift in (0.0, 2.4):
        for word, x in (("River", 20.0), ("depth", 60.0)):
            for i, t in enumerate(word):
                rows.append(glyph(t, x + shift + 5 * i, 50.0 + shift / 2, si))
                si += 1
    assert pages.page_lines(pd.DataFrame(rows)).text.tolist() == ["River depth"]


def test_pages_are_read_from_sorted_rows(spark):
    """Pages that go over several batches are whole and in order, and pages cost no grouped map each."""
    rows = spark.range(25_000).selectExpr("id % 7 AS doc_id", "CAST(id % 2 AS INT) AS page", "id AS n")
    got = pages.by_page(rows.repartition(5), lambda page: [(len(page), [r["n"] for r in page] == sorted(r["n"] for r in page))], "doc_id long, page int, rows int, sorted boolean", "n")
    assert sorted((r.doc_id, r.page, r.rows) for r in got.collect()) == sorted((r.doc_id, r.page, r["count"]) for r in rows.groupBy("doc_id", "page").count().collect())
    assert all(r.sorted for r in got.collect())
    words = spark.createDataFrame([(1, 1, 0, "a", 0.0, 8.0, 0.0, 10.0), (1, 1, 1, "a", 1.0, 9.0, 0.0, 10.0), (1, 2, 0, "a", 0.0, 8.0, 0.0, 10.0)], "doc_id long, page int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    found = pages.distinct_words(words)
    assert sorted((r.page, r.word_no) for r in found.collect()) == [(1, 0), (2, 0)] and found.columns == words.columns
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_page_vocabulary_comes_with_its_blocks(spark):
    """The same words as page_vocabulary() of the lines, and no join: the lines are in the plan once."""
    from lectern.operators import layout

    rows = spark.createDataFrame([(1, 1, 0, ["A well-known re-", "sult"]), (1, 1, 1, ["Result ", ""]), (2, 1, 0, ["ä b"])], "doc_id long, page int, block_no int, lines array<string>")
    got = {(r.doc_id, r.block_no): sorted(r.vocabulary) for r in layout.with_vocabulary(rows).collect()}
    lines = rows.selectExpr("doc_id", "page", "explode(lines) AS text")
    want = {r.doc_id: sorted(r.vocabulary) for r in layout.page_vocabulary(lines).collect()}
    assert got == {(1, 0): want[1], (1, 1): want[1], (2, 0): want[2]}


def test_more_rows_are_dealt_to_more_tasks(spark, monkeypatch):
    from lectern import session

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    assert session.dealt(spark.range(5_000), "id").rdd.getNumPartitions() == 50
    assert session.dealt(spark.range(5), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Stream layout: words, lines, paragraphs and reading order of drawn glyphs."""

import math
import random
import time

import pandas as pd
import pytest

from lectern.operators import pages, stream

W, H = 600.0, 800.0


def glyph(text, x, y, size=10.0, wide=0.5, font="Serif", turn=0.0, **more):
    """A glyph with its origin at x, y (downwards), `wide` sizes long."""
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    corners = [(x + u * c - v * s, y + u * s + v * c) for u in (0.0, wide * size) for v in (-0.75 * size, 0.25 * size)]
    xs, ys = zip(*corners, strict=True)
    return {"text": text, "size": size, "fontname": font, "matrix": [c, -s, s, c, x, H - y], "adv": wide * size, "x0": min(xs), "x1": max(xs), "top": min(ys), "bottom": max(ys)} | more


def drawn(text, x, y, size=10.0, wide=0.5, **more):
    return [glyph(t, x + i * wide * size, y, size, wide, **more) for i, t in enumerate(text)]


def read(glyphs, w=W, h=H, **more):
    shift = h - H
    return stream.page_blocks([g | {"matrix": [*g["matrix"][:5], g["matrix"][5] + shift]} if shift and g.get("matrix") else g for g in glyphs], w, h, **more)


def texts(found):
    return [" / ".join(x.text for x in b.lines) for b in found]


def paragraph(name, x, y, rows=2, size=10.0, letters=16, **more):
    return [g for k in range(rows) for g in drawn(f"{name} row{k} ".ljust(letters, "m"), x, y + 12 * k, size, **more)]


@pytest.mark.parametrize(("x", "n", "text"), [(211, 1, "ab"), (213, 2, "a b"), (203, 2, "ab"), (206, 1, "ab")])
def test_gaps_and_steps_back(x, n, text):
    """A gap over a tenth of the size is a blank; a step back over three tenths begins a word without one."""
    items = stream.prepared([glyph("a", 200, 300, 20), glyph("b", x, 300, 20)], W, H)
    assert len(stream.words(items)) == n
    assert texts(read([glyph("a", 200, 300, 20), glyph("b", x, 300, 20)])) == [text]


def test_baseline_within_a_word():
    for shift, n in ((0.9, 1), (5.0, 2)):
        assert len(stream.words(stream.prepared([glyph("a", 200, 300, 20), glyph("b", 210, 300 - shift, 20)], W, H))) == n


def test_scripts():
    raised = drawn("Lima", 100, 300, 20) + [glyph("2", 140, 292, 12)] + drawn(" Roe", 146, 300, 20)
    assert texts(read(raised)) == ["Lima 2 Roe"]
    assert texts(read(drawn("Lima", 100, 300, 20) + [glyph("2", 140, 292, 12)] + drawn(",", 146, 300, 20) + drawn(" Roe", 156, 300, 20))) == ["Lima 2, Roe"]
    assert texts(read(drawn("H", 100, 300, 20) + [glyph("2", 110, 304, 12)] + drawn("O is", 116, 300, 20))) == ["H2O is"]


@pytest.mark.parametrize("bad", [{"x0": float("nan")}, {"bottom": None}, {"size": float("inf")}, {"matrix": [1, 0, 0, 1, None, 2]}, {"matrix": [1, 0]}, {"text": "(cid:3)"}, {"text": " "}, {"matrix": [1, 0, 0, 1, 9000.0, 5.0]}])
def test_damaged_and_hidden_glyphs_end_words(bad):
    assert texts(read([*drawn("no", 50, 100), glyph("X", 60, 100) | bad, *drawn("tes", 60, 100)])) == ["no tes"]


def test_missing_numbers_are_made():
    g = glyph("a", 50, 100)
    for without in (("size",), ("matrix",), ("x0", "x1", "top", "bottom")):
        assert texts(read([{k: v for k, v in g.items() if k not in without}])) == ["a"]
    assert texts(read([g | {"size": 0.0}])) == ["a"] and read([]) == [] and read([glyph(" ", 5, 5)]) == []


def test_lines():
    begin = drawn("river", 100, 500, 10, 1.0)  # ends at 150
    for x, y, n in ((164, 500, 1), (167, 500, 2), (100, 512, 2), (60, 500, 2)):
        assert sum(len(b.lines) for b in read(begin + drawn("bank", x, y))) == n, (x, y)


def test_paragraphs():
    rows = lambda ys, sizes: [g for y, s in zip(ys, sizes, strict=True) for g in drawn("one row of text", 50, y, s)]
    assert len(read(rows((100, 112, 124), (10, 10, 10)))) == 1
    assert len(read(rows((100, 112, 130), (10, 10, 10)))) == 2
    assert len(read(rows((100, 112), (10, 10.3)))) == 1 and len(read(rows((100, 112), (10, 12)))) == 2
    assert len(read(drawn("• nets", 50, 100) + drawn("• boats", 50, 124))) == 1 and len(read(drawn("nets", 50, 100) + drawn("boats", 50, 124))) == 2
    assert texts(read(drawn("Head", 50, 60) + drawn("elsewhere", 300, 70) + drawn("again", 300, 82))) == ["Head", "elsewhere / again"]
    wide = read(drawn("Max Roe and Ana Lima", 70, 100) + drawn("Institute of Boats", 400, 100), 1000.0)
    assert len(wide) == 1 and wide[0].box[0] == pytest.approx(70) and len(wide[0].lines) == 2


def test_headings():
    bold = {"font": "ABCDEF+Serif-Bold"}
    assert texts(read(drawn("METHODS", 50, 100, **bold) + drawn("We went out by boat", 50, 112) + drawn("every day of May", 50, 124))) == ["METHODS", "We went out by boat / every day of May"]
    assert len(read(drawn("METHODS", 50, 100, **bold) + drawn("We went out by boat", 50, 112), split_headings=False)) == 1
    assert len(read(drawn("Depth.", 50, 100, **bold) + drawn(" It rose all day", 80, 100) + drawn("and all night", 50, 112))) == 1
    assert len(read(drawn("It rose all day", 50, 100) + drawn("SEE FIGURE", 50, 112, **bold) + drawn("and all night", 50, 124))) == 1
    assert len(read(drawn("Ana Lima", 50, 100, **bold) + drawn("ana@example.org", 50, 112))) == 1
    assert len(read(drawn("K12", 50, 100, **bold) + drawn("*", 50, 112))) == 1


def names(found):
    return [b.lines[0].text.split()[0] for b in found]


def test_reading_order():
    grid = [(c + str(r), 20 + 200 * i, 100 + 80 * (r - 1)) for r in (1, 2) for i, c in enumerate("ABC")]
    columns = [g for x in grid for g in paragraph(*x)]
    assert names(read(columns)) == ["A1", "A2", "B1", "B2", "C1", "C2"]
    assert names(read(columns + paragraph("Top", 20, 40, 1, letters=70))) == ["Top", "A1", "A2", "B1", "B2", "C1", "C2"]
    assert names(read(columns + paragraph("Bar", 20, 150, 1, letters=105))) == ["A1", "B1", "C1", "Bar", "A2", "B2", "C2"]
    pairs = [g for k in range(3) for g in drawn(f"Name{k} Roe", 20 + 190 * k, 100, 12) + drawn(f"{k}@example.org", 20 + 190 * k, 118)]
    assert [x.text for b in read(pairs) for x in b.lines] == [x for k in range(3) for x in (f"Name{k} Roe", f"{k}@example.org")]


def test_side_labels():
    page = drawn("Aim", 20, 104, 12, font="Serif-Bold") + paragraph("Body", 60, 100, 3, letters=40) + paragraph("Other", 60, 300, 2, letters=40)
    assert names(read(page)) == ["Aim", "Body", "Other"]


def test_interleaved_columns():
    page = [g for k in range(6) for x, c in ((20, "left"), (320, "right")) for g in drawn(f"{c} text {k}", x, 100 + 12 * k)]
    assert texts(read(page)) == [" / ".join(f"{c} text {k}" for k in range(6)) for c in ("left", "right")]


def test_accents():
    assert texts(read(drawn("caf", 100, 300, 20) + [glyph("´", 130, 294, 20), glyph("e", 130, 300, 20)])) == ["caf\u00e9"]
    assert texts(read([glyph("n", 100, 300, 20), glyph("~", 101, 293, 20)])) == ["\u00f1"]
    assert texts(read([glyph("´", 101, 293, 20), glyph("¨", 101, 293, 20), glyph("e", 100, 300, 20)])) == ["\u00e9"]
    assert texts(read([glyph("q", 100, 300, 20), glyph("´", 101, 293, 20)])) == ["q\u0301"]
    assert texts(read(drawn("x", 100, 300, 20) + [glyph("^", 109, 293, 20, 0.4), glyph("2", 112, 300, 20)])) == ["x^2"]
    assert texts(read(drawn("30", 100, 300, 20) + [glyph("\u00b0", 126, 300, 20, 0.3)])) == ["30 \u00b0"]


def test_overprints():
    one = drawn("Tall heading", 100, 100, 40, 0.3)
    again = [g | {"matrix": [*g["matrix"][:4], g["matrix"][4] + 0.5, g["matrix"][5] - 0.5], "x0": g["x0"] + 0.5, "x1": g["x1"] + 0.5} for g in one]
    assert texts(read(one + again)) == ["Tall heading"] and texts(read(drawn("hill all", 50, 100))) == ["hill all"]


def test_turned_text():
    page = [glyph(t, 300, 200 + 5 * i, turn=90.0) for i, t in enumerate("down")] + drawn("across", 50, 100)
    assert sorted(texts(read(page))) == ["across", "down"]


def test_box_of_the_page():
    page = paragraph("A", 20, 100) + paragraph("B", 220, 100)
    moved = [g | {k: g[k] + d for k, d in (("x0", -12), ("x1", -12), ("top", 30), ("bottom", 30))} for g in page]
    rounded = lambda found: [[round(v, 6) for v in b.box] for b in found]
    assert rounded(read(page)) == rounded(read(moved, left=-12.0, top=30.0))


def test_time_grows_with_the_page():
    def page(rows):
        return [g for k in range(rows) for g in drawn(("lorem ipsum dolor sit amet " * 2)[:50], 40 + 700 * (k % 3), 20 + 12 * (k // 3))]

    took = []
    for rows in (60, 600):
        glyphs = page(rows)
        began = time.perf_counter()
        assert read(glyphs, 2200.0, 3000.0)
        took.append(time.perf_counter() - began)
    assert took[1] < 4 and took[1] < 40 * max(took[0], 0.005)
    deep = [g for k in range(1500) for g in drawn("ab", 50, 20 + 30 * k)]
    assert len(read(deep, 600.0, 60000.0)) == 1500


def test_pages_of_a_table(spark):
    rows = [(d, 1, i, g["text"], g["x0"], g["x1"], g["top"], g["bottom"], g["size"], g["fontname"], g["matrix"]) for d in (1, 2) for i, g in enumerate(paragraph("A", 20, 100) + paragraph("B", 220, 100))]
    columns = ["doc_id", "page", "si", "text", "x0", "x1", "top", "bottom", "size", "fontname", "matrix"]
    got = stream.read_stream(spark.createDataFrame(pd.DataFrame(rows, columns=columns)).withColumnRenamed("page", "page").selectExpr("doc_id", "CAST(page AS INT) AS page", *columns[2:])).orderBy("doc_id", "line_no").collect()
    assert [(r.doc_id, r.block_no, r.line_no, r.text[:6]) for r in got] == [(d, b, n, f"{c} row{n % 2}") for d in (1, 2) for n, (b, c) in enumerate(((0, "A"), (0, "A"), (1, "B"), (1, "B")))]
    assert {r.engine for r in got} == {"stream"}


def spelled(gaps, size=10.0, letters="abcdefghijklmnop", blank_after=()):
    """Letters half a size wide with these gaps between them, in sizes; blanks drawn after some."""
    x, out = 50.0, []
    for i, t in enumerate(letters[: len(gaps) + 1]):
        out.append(glyph(t, x, 300, size))
        if i in blank_after:
            out.append(glyph(" ", x + 0.5 * size, 300, size))
        x += 0.5 * size + (gaps[i] if i < len(gaps) else 0) * size
    return out


@pytest.mark.parametrize(
    ("gaps", "more", "want"),
    [
        ([0.2, 0.2, 0.6, 0.2, 0.2, 0.2], {}, "abc defg"),
        ([0.2, 0.25, 0.6, 0.2, 0.29, 0.2], {}, "abc defg"),  # uneven, but within one and a half of the typical gap
        ([0.2, 0.31, 0.6, 0.2, 0.2, 0.2], {}, "ab c defg"),
        ([0.2] * 6, {}, "a b c d e f g"),  # no larger gap marks a word
        ([0.2, 0.2, 0.6, 0.2], {}, "a b c d e"),  # a short chain
        ([0.2, 0.2, 0.6, 0.2, 0.2, 0.2], {"blank_after": (3,)}, "a b c d e f g"),  # a blank breaks the chain
        ([0.05, 0.05, 0.6, 0.05, 0.05, 0.05], {}, "abc defg"),
    ],
)
def test_letter_spaced_words(gaps, more, want):
    assert texts(read(spelled(gaps, **more))) == [want]


def plain_order(blocks):
    """The band rule by definitions alone: any() over all blocks, a hop at a time."""
    tops = sorted(blocks, key=lambda b: (b["y0"], b["seq"]))
    row, rows = [], []
    for b in tops:
        if row and b["y0"] - row[-1]["y0"] > max(0.5, 0.1 * row[-1]["line_h"]):
            rows += sorted(row, key=lambda b: b["seq"])
            row = []
        row.append(b)
    rows += sorted(row, key=lambda b: b["seq"])
    n = len(rows)
    before = [k > 0 and (any(rows[k]["y0"] <= q["y1"] + q["line_h"] for q in rows[:k]) or rows[k]["y0"] - rows[k - 1]["y0"] <= rows[k]["line_h"]) for k in range(n)]
    after = [k + 1 < n and (rows[k + 1]["y0"] <= rows[k]["y1"] + rows[k]["line_h"] or any(q["y0"] - q["line_h"] <= rows[k]["y0"] for q in rows[k + 1 :])) for k in range(n)]
    width = max((b["x1"] for b in rows), default=0) - min((b["x0"] for b in rows), default=0)

    def banner(p, band):
        if p["x1"] - p["x0"] < 0.3 * width or any(q["y0"] < p["y0"] - 1e-6 and (q["x1"] <= p["x0"] or q["x0"] >= p["x1"]) for q in band if q is not p):
            return False
        under = sorted((q for q in band if q is not p and q["y0"] >= p["y1"] - 1e-6 and 0 < min(p["x1"], q["x1"]) - max(p["x0"], q["x0"]) >= 0.5 * (q["x1"] - q["x0"])), key=lambda q: q["x0"])
        return any(q["x0"] >= under[0]["x1"] for q in under)

    out, k = [], 0
    while k < n:
        j = k
        while j < n and (before[j] or after[j]):
            j += 1
        band = rows[k : max(j, k + 1)]
        placed = []
        for b in band:
            at = len(placed)
            while at > (k == 0 and j > k) and placed[at - 1]["x0"] > b["x1"] and not (placed[at - 1]["y1"] <= b["y0"] and banner(placed[at - 1], band)):
                at -= 1
            placed.insert(at, b)
        out += placed
        k += len(band)
    return [b["seq"] for b in out]


def test_band_rule_on_random_pages():
    rng = random.Random(8)
    for _ in range(400):
        blocks = []
        for seq in range(rng.randrange(0, 14)):
            x, y, w = rng.choice([20, 150, 280, 410, rng.randrange(500)]), rng.choice([rng.randrange(700), rng.randrange(0, 700, 60)]), rng.choice([100, 110, 240, 400, 560])
            blocks.append({"x0": float(x), "y0": y + rng.choice([0, 0, 0.3]), "x1": float(x + w), "y1": float(y + rng.choice([10, 24, 60, 200])), "line_h": rng.choice([8.0, 10.0, 20.0]), "seq": seq})
        rng.shuffle(blocks)
        assert [b["seq"] for b in pages.reading_order(blocks)] == plain_order(blocks)


def test_hops_are_bounded():
    blocks = [{"x0": 300.0, "x1": 400.0, "y0": 5.0 * i, "y1": 5.0 * i + 4, "line_h": 10.0, "seq": i} for i in range(20)]
    left = {"x0": 0.0, "x1": 100.0, "y0": 101.0, "y1": 110.0, "line_h": 10.0, "seq": 20}
    assert [b["seq"] for b in pages.reading_order([*blocks, left])].index(20) == 1  # the first block of the page stays first
    assert [b["seq"] for b in pages.reading_order([*blocks, left], 4)].index(20) == 16

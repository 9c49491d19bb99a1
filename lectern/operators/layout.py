"""Page layout over glyphs, words, lines, blocks, regions: what windows and joins can express. Rows are keyed by doc_id and page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text

PAGE = ("doc_id", "page")


def mode_size(glyphs: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """The most frequent size, to half points; of equals the larger."""
    sized = glyphs.groupBy(*keys, (F.round(F.col("size") * 2) / 2).alias("s")).count()
    return sized.groupBy(*keys).agg(F.max_by("s", F.struct("count", "s")).alias("mode_size"))


def glyph_stats(glyphs: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Box, mean and least size, median size, and the gap that parts words: a quarter of the median within 1.5 to 3, at most 0.7 of a blank's width."""
    blank = F.median(F.when(F.btrim("text") == "", F.col("x1") - F.col("x0")))
    ink = F.btrim("text") != ""
    g = glyphs.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.avg("size").alias("mean_size"), F.min("size").alias("min_size"), F.median(F.when(ink, F.col("size"))).alias("median_size"), blank.alias("blank"))
    tol = F.greatest(F.lit(1.5), F.least(F.lit(3.0), F.col("median_size") * 0.25))
    return g.withColumn("x_tol", F.least(tol, F.coalesce(F.col("blank") * 0.7, tol))).drop("blank")


def gaps(boxes: DataFrame, start: str, end: str, keys: tuple[str, ...] = PAGE, least: float = 0.01) -> DataFrame:
    """mid and width of what no interval covers: the running maximum of ends before each start."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    x = boxes.withColumn("upto", F.max(end).over(w)).where(F.col(start) > F.col("upto") + least)
    return x.select(*keys, ((F.col("upto") + F.col(start)) / 2).alias("mid"), (F.col(start) - F.col("upto")).alias("width"))


def weighted_median(rows: DataFrame, value: str, weight: str, keys: tuple[str, ...] = PAGE, larger: bool = True) -> DataFrame:
    """The value at which half of all weight is reached, from the large end or the small."""
    summed = rows.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    order = F.desc(value) if larger else F.asc(value)
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = summed.withColumns({"upto": F.sum("w").over(run), "total": F.sum("w").over(Window.partitionBy(*keys))}).where("upto >= total / 2")
    return x.groupBy(*keys).agg((F.max(value) if larger else F.min(value)).alias("median"))


def body_size(blocks: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Size of running text: the lower weighted median over blocks of 60 characters or more that are no figure text."""
    long_ = blocks.where((F.length(F.btrim("text")) >= 60) & ~F.coalesce("fig", F.lit(False)) & (F.col("fontsize") > 0))
    sized = long_.select(*keys, (F.round(F.col("fontsize") * 2) / 2).alias("s"), F.length(F.btrim("text")).alias("w"))
    return weighted_median(sized, "s", "w", keys, larger=False).withColumnRenamed("median", "body_size")


def dominant_baseline(words: DataFrame, keys: tuple[str, ...] = (*PAGE, "line_no"), step: float = 1.0) -> DataFrame:
    """Baseline of the heaviest cluster of word baselines (v, weight w): clusters part where the next is over step away."""
    order = Window.partitionBy(*keys).orderBy("v")
    x = words.withColumn("new", (F.col("v") - F.lag("v").over(order) > step).cast("int"))
    x = x.withColumn("cluster", F.coalesce(F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    heavy = x.groupBy(*keys, "cluster").agg(F.sum("w").alias("weight")).groupBy(*keys).agg(F.max_by("cluster", F.struct("weight", -F.col("cluster"))).alias("cluster"))
    return weighted_median(x.join(heavy, [*keys, "cluster"]), "v", "w", keys).withColumnRenamed("median", "baseline")


def baseline_lines(glyphs: DataFrame, keys: tuple[str, ...] = PAGE, tolerance: float = 0.5) -> DataFrame:
    """glyphs with line_no: a line ends where the next bottom is over tolerance mean sizes away."""
    order = Window.partitionBy(*keys).orderBy("bottom", "x0")
    mean = F.avg("size").over(Window.partitionBy(*keys))
    x = glyphs.withColumn("_new", (F.col("bottom") - F.lag("bottom").over(order) > tolerance * F.greatest(mean, F.lit(1.0))).cast("int"))
    return x.withColumn("line_no", F.coalesce(F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("int")).drop("_new")


def words(glyphs: DataFrame, x_tol: Column | float, keys: tuple[str, ...] = (*PAGE, "line_no")) -> DataFrame:
    """Words of lines: a new one begins after a gap over x_tol from what was reached so far, a blank, or a step between small and normal size."""
    order = Window.partitionBy(*keys).orderBy("x0", "x1", "si")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    mode = F.mode(F.round(F.col("size") * 2) / 2, True).over(Window.partitionBy(*keys))
    x = glyphs.withColumns({"_blank": F.btrim("text") == "", "_small": F.col("size") < 0.8 * mode})
    tol = F.lit(x_tol) if isinstance(x_tol, float) else x_tol
    ink = F.when(~F.col("_blank"), F.col("x1"))
    x = x.withColumns({"_gap": F.col("x0") - F.max(ink).over(upto) > tol, "_after": F.lag("_blank").over(order), "_flip": F.col("_small") != F.last(F.when(~F.col("_blank"), F.col("_small")), True).over(upto)})
    new = F.coalesce(F.col("_gap"), F.lit(False)) | F.coalesce(F.col("_after"), F.lit(False)) | F.coalesce(F.col("_flip"), F.lit(False))
    x = x.withColumn("word_no", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("_blank"))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "si", "text"))), lambda g: g["text"]), "")
    return x.groupBy(*keys, "word_no").agg(letters.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.mode(F.col("size"), True).alias("size"), F.mode("fontname", True).alias("fontname"))


def lines(words_: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Lines of words: text in order of x, box, dominant size, bold if more than half of the words are."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))), lambda w: w["text"]), " ")
    return words_.groupBy(*keys, "line_no").agg(parts.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.mode(F.col("size"), True).alias("size"), (F.avg(text.is_bold("fontname").cast("double")) > 0.5).alias("bold"))


def blocks(lines_: DataFrame, order: str = "line_no", keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Blocks of lines in reading order. A new one begins after a gap over 1.5 median line heights, at a size ratio over 1.3, at a change of weight
    beside a short line, at an upward jump, or in another region, unless the line goes on with the sentence before."""
    w, page = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    x = lines_ if "region" in lines_.columns else lines_.withColumn("region", F.lit(0))
    lag = lambda c: F.lag(c).over(w)
    height = F.greatest(F.col("bottom") - F.col("top"), F.lit(1.0))
    x = x.withColumn("_median", F.percentile_approx(height, 0.5).over(page)).withColumns({"_bottom": lag("bottom"), "_top": lag("top"), "_size": lag("size"), "_bold": lag("bold"), "_text": lag("text"), "_region": lag("region")})
    gap = F.col("top") - F.col("_bottom")
    ratio = F.greatest("size", "_size") / F.greatest(F.least("size", "_size"), F.lit(0.1))
    short = (F.length("text") <= 120) | (F.length("_text") <= 120)
    moved = ((F.col("region") != F.col("_region")) | (F.col("top") < F.col("_top") - 0.25 * F.greatest(F.col("_bottom") - F.col("_top"), F.lit(1.0)))) & ~continues(F.col("_text"), F.col("text"))
    new = (gap > 1.5 * F.col("_median")) | (ratio > 1.3) | ((F.col("bold") != F.col("_bold")) & (gap > 0) & short) | moved
    x = x.withColumn("block_no", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda t: t["text"])
    return x.groupBy(*keys, "block_no").agg(parts.alias("lines"), F.min("x0").alias("hpos"), F.min("top").alias("vpos"), (F.max("x1") - F.min("x0")).alias("width"), (F.max("bottom") - F.min("top")).alias("height"), F.mode(F.col("size"), True).alias("fontsize"), (F.avg(F.col("bold").cast("double")) > 0.5).alias("bold"), F.first("region").alias("region"))


def continues(before: Column, now: Column) -> Column:
    """now goes on with the sentence before: begins in lower case after three words without an end."""
    return now.rlike(r"^\s*\p{Ll}") & (F.size(text.words(before)) >= 3) & ~F.rtrim(before).rlike("[.!?:;…)\\]\"”]$")


def joined(lines_: Column, vocabulary: Column) -> Column:
    """Lines as one text. A hyphen at a line's end goes if the joined word is on the page and the hyphenated is not; else it stays, without a blank."""

    def add(acc: Column, line: Column) -> Column:
        left = F.lower(F.regexp_extract(acc, r"(\p{L}{2,})-$", 1))
        right = F.lower(F.regexp_extract(line, "^([a-zß-ÿ]+)", 1))
        cut = (left != "") & (right != "") & ~acc.endswith("--")
        drop = F.array_contains(vocabulary, F.concat(left, right)) & ~F.array_contains(vocabulary, F.concat(left, F.lit("-"), right))
        return F.when(acc == "", line).when(cut & drop, F.concat(F.regexp_replace(acc, "-$", ""), line)).when(cut, F.concat(acc, line)).otherwise(F.concat(acc, F.lit(" "), line))

    return F.aggregate(lines_, F.lit(""), add)


def page_vocabulary(lines_: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Distinct lower-case words of a page, hyphens inside kept."""
    w = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:-\p{L}+)*"), F.lit(0)))
    return lines_.select(*keys, w.alias("w")).groupBy(*keys).agg(F.array_sort(F.collect_set("w")).alias("vocabulary"))


def with_vocabulary(blocks_: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """blocks with the vocabulary of their page, of the lines that they hold: the lines are not made a second time for it."""
    w = F.flatten(F.transform("lines", lambda t: F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"\p{L}+(?:-\p{L}+)*"), F.lit(0))))
    return blocks_.withColumn("vocabulary", F.array_distinct(F.flatten(F.collect_list(F.array_distinct(w)).over(Window.partitionBy(*keys)))))


def partition(blocks_: DataFrame, page_h: float, median_size: float, col_start: float, col_end: float, span: float, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """blocks (seq) with kind header, meta, body or footer and place, the order in which they are read.

    The leading run of blocks in title size (1.4 of the median) is the headline; wide blocks below the columns are footers; contact blocks of
    the top zone come before the body, by rows, unless the block before is an ordinary one of that zone."""
    w = Window.partitionBy(*keys).orderBy("seq")
    end = F.col("vpos") + F.col("height")
    title = (F.lit(median_size) > 0) & (F.col("fontsize") >= 1.4 * median_size) & (end <= col_start + 0.02 * page_h)
    wide, top = F.col("width") > span, end <= 0.12 * page_h
    x = blocks_.withColumn("_head", F.min(title.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    meta = ~wide & top & F.col("text").rlike(r"@\S+\.\S+|orcid\.org|ORCID:\s*\d|^Authors?\b")
    x = x.withColumn("_raw", F.when(F.col("_head"), "header").when(wide & (F.col("vpos") > col_end), "footer").when(meta, "meta").when(top, "top").otherwise("body"))
    # A run of contact blocks right after an ordinary top block stays with it.
    x = x.withColumn("_lead", F.last(F.when(F.col("_raw") != "meta", F.col("_raw")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    kind = F.when((F.col("_raw") == "meta") & (F.col("_lead") == "top"), "body").when(F.col("_raw") == "top", "body").otherwise(F.col("_raw"))
    x = x.withColumn("kind", kind)
    rank = F.when(F.col("kind") == "header", 0).when(F.col("kind") == "meta", 1).when(F.col("kind") == "body", 2).otherwise(3)
    tol = max(2.0, 0.5 * median_size)
    row = F.when(F.col("kind") == "meta", F.floor(F.col("vpos") / tol)).when(F.col("kind") == "body", F.lit(0)).otherwise(F.col("vpos"))
    inner = F.when(F.col("kind") == "meta", F.col("hpos")).when(F.col("kind") == "body", F.col("seq")).otherwise(F.lit(0.0))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(rank, row.cast("double"), inner.cast("double"), "seq"))
    return x.withColumn("place", place).drop("_head", "_raw", "_lead")


def column_boundaries(blocks_: DataFrame, page_w: float, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Up to six boundaries at the widest gaps between block centres: over 5 % of the width, with three blocks or more on either side."""
    order = Window.partitionBy(*keys).orderBy("cx")
    x = blocks_.withColumn("cx", F.col("hpos") + F.col("width") / 2)
    x = x.withColumns({"before": F.lag("cx").over(order), "n": F.row_number().over(order), "all": F.count("*").over(Window.partitionBy(*keys))})
    x = x.where((F.col("cx") - F.col("before") > 0.05 * page_w) & (F.col("n") > 3) & (F.col("all") - F.col("n") >= 2))
    widest = Window.partitionBy(*keys).orderBy((F.col("before") - F.col("cx")), "cx")
    return x.withColumn("_r", F.row_number().over(widest)).where("_r <= 6").select(*keys, ((F.col("before") + F.col("cx")) / 2).alias("boundary"))


def cells(x0: Column, x1: Column, size: float) -> Column:
    return F.sequence(F.floor(x0 / size), F.floor(x1 / size))


def inside(points: DataFrame, regions: DataFrame, x: str, y: str, cell: float = 50.0, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """points with the smallest region_id that holds them: an equi-join on page and grid row, then the exact test."""
    r = regions.withColumn("_cell", F.explode(cells(F.col("top"), F.col("bottom"), cell))).select(*keys, "_cell", "region_id", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("top").alias("_y0"), F.col("bottom").alias("_y1"))
    p = points.withColumn("_cell", F.floor(F.col(y) / cell))
    hit = p.join(r, [*keys, "_cell"]).where(F.col(x).between(F.col("_x0"), F.col("_x1")) & F.col(y).between(F.col("_y0"), F.col("_y1")))
    own = [c for c in points.columns if c not in keys]
    first = hit.groupBy(*keys, *own).agg(F.min("region_id").alias("region_id"))
    return points.join(first, [*keys, *own], "left")


def blank_in_glyph(glyphs: DataFrame, keys: tuple[str, ...] = PAGE, cell: float = 10.0) -> DataFrame:
    """glyphs without blanks whose box lies within that of another glyph of the row."""
    ink = glyphs.where(F.btrim("text") != "")
    blanks = glyphs.where(F.btrim("text") == "").withColumn("_c", F.floor(F.col("top") / cell))
    near = ink.withColumn("_c", F.explode(F.sequence(F.floor(F.col("top") / cell) - 1, F.floor(F.col("top") / cell) + 1))).select(*keys, "_c", F.col("x0").alias("_a"), F.col("x1").alias("_b"), F.col("top").alias("_t"), F.col("bottom").alias("_u"))
    free = blanks.join(near, [*[blanks[k] == near[k] for k in keys], blanks["_c"] == near["_c"], blanks["x0"] >= near["_a"], blanks["x1"] <= near["_b"], F.abs(blanks["top"] - near["_t"]) <= 1.0], "left_anti").drop("_c")
    return ink.unionByName(free)


def table_like(words_: DataFrame, keys: tuple[str, ...] = (*PAGE, "region_id")) -> DataFrame:
    """Regions whose words stand in a grid: 6 words, 3 rows, 0.6 of the rows with several words, two column starts in 0.6 of those."""
    size = F.greatest(F.percentile_approx("size", 0.5).over(Window.partitionBy(*keys)), F.lit(1.0))
    x = words_.withColumn("_s", size).withColumns({"_row": F.round((F.col("top") + F.col("bottom")) / 2 / (0.8 * F.col("_s"))), "_col": F.round(F.col("x0") / (1.5 * F.col("_s")))})
    rows = x.groupBy(*keys, "_row").agg(F.count("*").alias("n"))
    facts = rows.groupBy(*keys).agg(F.sum("n").alias("words"), F.count("*").alias("rows"), F.sum((F.col("n") >= 2).cast("int")).alias("multi"))
    starts = x.join(rows.where("n >= 2").select(*keys, "_row"), [*keys, "_row"]).select(*keys, "_row", "_col").distinct().groupBy(*keys, "_col").count().join(facts, list(keys)).where("count >= 0.6 * multi").groupBy(*keys).agg(F.count("*").alias("repeated"))
    return facts.join(starts, list(keys), "left").select(*keys, ((F.col("words") >= 6) & (F.col("rows") >= 3) & (F.col("multi") >= 0.6 * F.col("rows")) & (F.coalesce("repeated", F.lit(0)) >= 2)).alias("table_like"))


def figure_words(words_: DataFrame, body: float, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """words (line_no, region_id, kind of the region, text, size, fontname, top, bottom) with label: words of figures and tables, not of the text.

    Lines that are captions, large (1.3 of the body) or short and bold stay text. A region's words are labels if 0.2 of them at most stand in rows of six
    or more, and they are 12 at most or 0.4 of them numbers on an image, or 0.3 of them numbers and 400 at most in a graphic."""
    line = Window.partitionBy(*keys, "line_no")
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text")).over(line)), lambda w: w["text"]), " ")
    bold = (F.avg(text.is_bold("fontname").cast("double")).over(line) > 0.5) & (F.count("*").over(line) <= 8)
    x = words_.withColumn("_kept", text_of.rlike(r"(?i)^\W*(?:fig(?:ure)?|tab(?:le)?)\.?\s*\d") | (F.max("size").over(line) >= 1.3 * body) | bold)
    inside_ = x.where(F.col("region_id").isNotNull() & ~F.col("_kept"))
    row = Window.partitionBy(*keys, "region_id", F.round((F.col("top") + F.col("bottom")) / 2 / F.greatest(F.lit(0.8 * body), F.lit(1.0))))
    facts = inside_.withColumns({"_prose": (F.count("*").over(row) >= 6).cast("double"), "_number": text.is_numeric_token("text").cast("double")}).groupBy(*keys, "region_id", "kind").agg(F.count("*").alias("n"), F.avg("_prose").alias("prose"), F.avg("_number").alias("numbers"))
    image = (F.col("kind") == "image") & ((F.col("n") <= 12) | (F.col("numbers") >= 0.4))
    graphic = (F.col("kind") != "image") & (F.col("numbers") >= 0.3) & (F.col("n") <= 400)
    labels = facts.where((F.col("prose") <= 0.2) & (image | graphic)).select(*keys, "region_id").withColumn("_label", F.lit(True))
    out = x.join(labels, [*keys, "region_id"], "left")
    return out.withColumn("label", F.coalesce(F.col("_label") & ~F.col("_kept"), F.lit(False))).drop("_kept", "_label")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def box(x0: Column | str, y0: Column | str, x1: Column | str, y1: Column | str) -> Column:
    return F.struct(*((c if isinstance(c, Column) else F.col(c)).cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)))


def near_pairs(left: DataFrame, right: DataFrame, left_box: Column, right_box: Column, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Pairs of left and right rows of a page whose boxes (of box()) meet, each once; other columns must have different names.

    Both sides are dealt to the cells of a grid that their boxes lie in. A cell is as wide and as high as the page's boxes are in the mean (of squares), so
    that a box lies in four cells in the mean, however long the page; a pair is met in every cell that both lie in, and kept in the one where their
    intersection begins. So the work follows the overlaps, not the square of a page's boxes. Boxes without a place are in no pair."""
    pairs, meet = _in_cells(left, right, left_box, right_box, keys)
    return pairs.where(meet).drop("_l", "_r", "_i", "_j", "_x", "_y", "_w", "_h")


def _in_cells(left: DataFrame, right: DataFrame, left_box: Column, right_box: Column, keys: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """Pairs that share a cell, and whether it is the one that keeps them."""
    a, b = left.withColumn("_l", left_box), right.withColumn("_r", right_box)
    edges = a.select(*keys, F.col("_l").alias("e")).unionAll(b.select(*keys, F.col("_r").alias("e")))
    mean = lambda low, high: F.sqrt(F.avg((F.col(high) - F.col(low)) * (F.col(high) - F.col(low))))
    grid = edges.groupBy(*keys).agg(F.min("e.x0").alias("_x"), F.min("e.y0").alias("_y"), F.max("e.x1").alias("_xx"), F.max("e.y1").alias("_yy"), mean("e.x0", "e.x1").alias("_mw"), mean("e.y0", "e.y1").alias("_mh"), F.count(F.lit(1)).alias("_n"))
    size = lambda low, high, own: F.greatest(F.col(own), (F.col(high) - F.col(low)) / F.col("_n"), F.lit(1e-9))
    grid = grid.select(*keys, "_x", "_y", size("_x", "_xx", "_mw").alias("_w"), size("_y", "_yy", "_mh").alias("_h"))
    across = lambda x: F.floor((x - F.col("_x")) / F.col("_w"))
    down = lambda y: F.floor((y - F.col("_y")) / F.col("_h"))

    def dealt(df: DataFrame, name: str) -> DataFrame:
        e = F.col(name)
        there = e["x0"].isNotNull() & e["y0"].isNotNull() & (e["x0"] <= e["x1"]) & (e["y0"] <= e["y1"])
        spread = df.where(there).join(grid, list(keys)).withColumn("_i", F.explode(F.sequence(across(e["x0"]), across(e["x1"]))))
        return spread.withColumn("_j", F.explode(F.sequence(down(e["y0"]), down(e["y1"]))))

    pairs = dealt(a, "_l").join(dealt(b, "_r").drop("_x", "_y", "_w", "_h"), [*keys, "_i", "_j"])
    l, r = F.col("_l"), F.col("_r")
    begins_x, begins_y = F.greatest(l["x0"], r["x0"]), F.greatest(l["y0"], r["y0"])
    meet = (begins_x <= F.least(l["x1"], r["x1"])) & (begins_y <= F.least(l["y1"], r["y1"])) & (F.col("_i") == across(begins_x)) & (F.col("_j") == down(begins_y))
    return pairs, meet


def panels(regions: DataFrame, blocks_: DataFrame, body: float, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Regions that are boxes around running text: they cover 0.8 of a block of 25 words in body size."""
    b = blocks_.where((F.size(text.letter_words("text")) >= 25) & (F.col("fontsize") >= 0.9 * body)).select(*keys, "hpos", "vpos", "width", "height")
    right, bottom = F.col("hpos") + F.col("width"), F.col("vpos") + F.col("height")
    area = overlap(F.col("x0"), F.col("x1"), F.col("hpos"), right) * overlap(F.col("top"), F.col("bottom"), F.col("vpos"), bottom)
    pairs = near_pairs(regions, b, box("x0", "top", "x1", "bottom"), box("hpos", "vpos", right, bottom), keys)
    return pairs.where(area >= 0.8 * F.greatest(F.col("width") * F.col("height"), F.lit(1e-6))).select(*regions.columns).distinct()


def beside(blocks_: DataFrame, regions: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Blocks (block_no) with the nearest region they may be the caption of: side and gap, bounded by the block's size."""
    fs = F.greatest("fontsize", F.lit(1.0))
    right, bottom = F.col("hpos") + F.col("width"), F.col("vpos") + F.col("height")
    reach = box(F.col("hpos") - 2.5 * fs, F.col("vpos") - 2.5 * fs, right + 2.5 * fs, bottom + 2.5 * fs)
    own = blocks_.select(*keys, "block_no", "fontsize", "hpos", "vpos", "width", "height")
    x = near_pairs(own, regions.select(*keys, "region_id", "x0", "x1", "top", "bottom"), reach, box("x0", "top", "x1", "bottom"), keys)
    over = overlap(F.col("hpos"), right, F.col("x0"), F.col("x1")) / F.greatest(F.least(F.col("width"), F.col("x1") - F.col("x0")), F.lit(1e-6))
    along = overlap(F.col("vpos"), bottom, F.col("top"), F.col("bottom")) / F.greatest(F.least(F.col("height"), F.col("bottom") - F.col("top")), F.lit(1e-6))
    below, above, at_right, at_left = F.col("vpos") - F.col("bottom"), F.col("top") - bottom, F.col("hpos") - F.col("x1"), F.col("x0") - right
    fit = lambda d, most: d.between(-0.5 * fs, most * fs)
    side = F.when((over >= 0.5) & fit(below, 2.5), F.struct(F.lit("below").alias("side"), below.alias("gap"))).when((over >= 0.5) & fit(above, 2.5), F.struct(F.lit("above").alias("side"), above.alias("gap"))).when((along >= 0.6) & fit(at_right, 2.0), F.struct(F.lit("right").alias("side"), at_right.alias("gap"))).when((along >= 0.6) & fit(at_left, 2.0), F.struct(F.lit("left").alias("side"), at_left.alias("gap")))
    x = x.withColumn("_s", side).where("_s is not null")
    best = F.min_by(F.struct("region_id", "_s.side", "_s.gap"), F.struct("_s.gap", "region_id"))
    return x.groupBy(*keys, "block_no").agg(best.alias("b")).select(*keys, "block_no", "b.region_id", "b.side", "b.gap")


def bands(blocks_: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """blocks (x0, y0, x1, y1, line_h, seq) with band: blocks that overlap in height, within a line, with one before or after share a band; others stand alone."""
    w = Window.partitionBy(*keys).orderBy("y0", "seq")
    reach = F.max(F.col("y1") + F.col("line_h")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.col("y0") - F.col("line_h")).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = (F.col("y0") <= reach) | (F.col("y0") - F.lag("y0").over(w) <= F.col("line_h"))
    after = (F.lead("y0").over(w) <= F.col("y1") + F.col("line_h")) | (later <= F.col("y0"))
    x = blocks_.withColumn("_in", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))
    new = ~F.col("_in") | ~F.coalesce(F.lag("_in").over(w), F.lit(False))
    return x.withColumn("band", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_in")


def side_labels(blocks_: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """seq of short bold or large blocks that stand left of a text they name, with the seq of that text (names)."""
    b = blocks_.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("seq", "x0", "y0", "x1", "y1", "size", "bold", "line_h")])
    r = blocks_.select(*keys, *[F.col(c).alias(f"r_{c}") for c in ("seq", "x0", "y0", "x1", "y1", "size")])
    tall = 0.5 * F.col("b_line_h")
    pair = near_pairs(b, r, box("b_x1", F.col("b_y0") - tall, F.col("b_x1") + 6 * F.col("b_size"), F.col("b_y1") + tall), box("r_x0", "r_y0", "r_x1", "r_y1"), keys)
    pair = pair.where("b_seq != r_seq and r_x0 >= b_x1 and r_x0 - b_x1 <= 6 * b_size and r_y0 - 0.5 * b_line_h <= b_y0 and b_y1 <= r_y1 + 0.5 * b_line_h and r_y1 - r_y0 >= b_y1 - b_y0")
    pair = pair.where("(b_bold or b_size > 1.1 * r_size) and r_x1 - r_x0 > b_x1 - b_x0")
    best = pair.groupBy(*keys, "b_seq", "b_x0", "b_x1", "b_y0", "b_y1").agg(F.min_by("r_seq", F.struct(F.col("r_x0") - F.col("b_x1"), "r_seq")).alias("names"))
    under = box("b_x0", F.col("b_y1") - 1e-6, "b_x1", F.col("b_y1") + 3 * (F.col("b_y1") - F.col("b_y0")))
    own = near_pairs(best, r, under, box("r_x0", "r_y0", "r_x1", "r_y1"), keys).where("r_seq != b_seq and r_y0 >= b_y1 - 1e-6 and r_y0 - b_y1 <= 3 * (b_y1 - b_y0)")
    own = own.where(overlap(F.col("b_x0"), F.col("b_x1"), F.col("r_x0"), F.col("r_x1")) >= 0.3 * F.least(F.col("b_x1") - F.col("b_x0"), F.col("r_x1") - F.col("r_x0"))).select(*keys, "b_seq").distinct()
    return best.join(own, [*keys, "b_seq"], "left_anti").select(*keys, F.col("b_seq").alias("seq"), "names")


def label_after(labels: DataFrame, body: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """labels (seq) with after: the latest body block before each, as of its order. One window over both."""
    both = labels.select(*keys, "seq", F.lit(None).cast("int").alias("body"), F.lit(True).alias("label")).unionByName(body.select(*keys, "seq", F.col("seq").cast("int").alias("body"), F.lit(False).alias("label")))
    w = Window.partitionBy(*keys).orderBy("seq", "label").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("after", F.last("body", True).over(w)).where("label").select(*keys, "seq", "after")


def title_candidate(lines_: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Text and size of the topmost run of lines in the largest sizes (0.6 of the largest), 3 to 40 words; no addresses, no author lines.

    A run goes on while sizes stay within a quarter and gaps within the size; an event's name in its first line is left out."""
    x = lines_.where((F.btrim("text") != "") & ~F.col("text").rlike(r"(?i)(https?://|www\.|\.(com|org|edu|net|gov|io)\b|@)") & ~text.is_author_line("text"))
    x = x.withColumn("big", F.col("size") >= 0.6 * F.max("size").over(Window.partitionBy(*keys)))
    w = Window.partitionBy(*keys).orderBy("top", "line_no")
    x = x.where("big").withColumn("_new", ((F.col("top") - F.lag("bottom").over(w) > F.col("size")) | (F.abs(F.col("size") / F.lag("size").over(w) - 1) > 0.25)).cast("int"))
    x = x.withColumn("run", F.coalesce(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    held = F.transform(F.array_sort(F.collect_list(F.struct("top", "line_no", "text"))), lambda t: F.btrim(t["text"]))
    venue = r"(?i)\b(conference|symposium|congress|workshop|annual meeting|proceedings|summit)\b"
    held = F.filter(held, lambda t, i: (i > 0) | (F.size(held) == 1) | ~t.rlike(venue))
    parts = F.regexp_replace(F.array_join(held, " "), r"(\p{L})- (?=\p{Ll})", "$1")
    runs = x.groupBy(*keys, "run").agg(parts.alias("candidate"), F.max("size").alias("size")).withColumn("n", F.size(text.words("candidate"))).where("n between 3 and 40")
    return runs.groupBy(*keys).agg(F.min_by(F.struct("candidate", "size"), "run").alias("t")).select(*keys, "t.candidate", "t.size")

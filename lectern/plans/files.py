"""From files to records: scan, glyphs, blocks, headed text, captions, title and links, the text that is best, and the plan of plans.document.

A document whose answer runs away from its text is read again by the other layout engine. There is a result for each file."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import attempts, layout, pages, stream
from lectern.plans import document
from lectern.session import staged
from lectern.sources import files
from lectern.sources.adapters import Options

CAPTIONS = "array<struct<kind:string,text:string>>"
PAGE = ["doc_id", "page"]
#: Where a title is looked for: the upper share of the first page, in sizes of at least so many middle sizes.
TITLE_ZONE, TITLE_SIZE = 0.35, 1.6


def stream_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of stream.read_stream(): doc_id, page, block_no, rows (texts of lines), text, hpos, vpos, width, height, fontsize, bold."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    out = lines.groupBy(*PAGE, "block_no").agg(
        rows.alias("rows"), F.min("x0").alias("hpos"), F.min("top").alias("vpos"), (F.max("x1") - F.min("x0")).alias("width"), (F.max("bottom") - F.min("top")).alias("height"), F.max("size").alias("fontsize"), F.min("bold").alias("bold")
    )
    return out.withColumn("text", F.array_join("rows", " "))


def cut_blocks(glyphs: DataFrame) -> DataFrame:
    """The same by the recursive cut; turned glyphs are told by their matrix, too."""
    if "matrix" in glyphs.columns:
        glyphs = glyphs.withColumn("upright", ~text.is_rotated(F.col("upright"), F.col("matrix")))
    found = layout.blocks(pages.read_pages(glyphs)).withColumnRenamed("lines", "rows").withColumn("text", F.array_join("rows", " "))
    return found.select(*PAGE, "block_no", "rows", "hpos", "vpos", "width", "height", "fontsize", "bold", "text")


def headed_text(blocks: DataFrame) -> DataFrame:
    """doc_id, layout_text: blocks (page, block_no, rows, text, fontsize, bold) as lines of text, those that look like headers as "## " lines.

    A header is a block of two lines at most that is bold, or over 1.3 times the document's middle size, in the form of a header."""
    middle = blocks.groupBy("doc_id").agg(F.percentile("fontsize", 0.5, F.size("rows")).alias("middle"))
    one = F.array_join("rows", " ")
    big = F.col("bold") & (F.col("fontsize") >= F.col("middle")) | (F.col("fontsize") > 1.3 * F.col("middle"))
    head = (F.size("rows") <= 2) & (F.length(one) <= 120) & one.rlike(r"^\p{L}") & big & text.looks_like_header(one)
    part = F.when(head, F.concat(F.lit("## "), one)).otherwise(F.array_join("rows", "\n"))
    ordered = blocks.join(middle, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "block_no", part.alias("t")))).alias("parts"))
    return ordered.select("doc_id", F.array_join(F.transform("parts", lambda x: x["t"]), "\n").alias("layout_text"))


def found_captions(blocks: DataFrame, objects: DataFrame) -> DataFrame:
    """doc_id, found_captions (kind, text, in order): captions by their labels, and sentences beside figures, which are images and groups of shapes that are no panels
    around text. objects: doc_id, page, kind (image, line, rect, curve; links have no bearing), x0, top, x1, bottom, page_w, page_h."""
    body = layout.body_size(blocks.withColumn("fig", F.lit(False)), ("doc_id",)).withColumnRenamed("body_size", "body")
    fallback = blocks.groupBy("doc_id").agg(F.percentile("fontsize", 0.5).alias("middle"))
    body = fallback.join(body, "doc_id", "left").select("doc_id", F.coalesce("body", "middle", F.lit(10.0)).cast("double").alias("body"))
    sized = staged(blocks.withColumn("block_no", F.col("block_no").cast("int")).join(body, "doc_id"))
    regions = staged(pages.mask_rows(objects.where("kind != 'link'").join(body, "doc_id")))
    regions = regions.join(layout.panels(regions, sized, F.col("body")).select(*PAGE, "region_id"), [*PAGE, "region_id"], "left_anti")
    got = pages.captions(sized, layout.beside(sized, regions), 10.0)
    one = F.transform(F.array_sort(F.collect_list(F.struct("page", "cap_no", "kind", "text"))), lambda c: F.struct(c["kind"].alias("kind"), c["text"].alias("text")))
    return got.groupBy("doc_id").agg(one.alias("found_captions"))


def title_candidates(lines: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """doc_id, candidate: the printed title, large at the top of the first page. lines: of stream.read_stream(); page_sizes: doc_id, page, page_h."""
    first = lines.groupBy("doc_id").agg(F.min("page").alias("page"), F.percentile("size", 0.5).alias("middle"))
    top = lines.join(first, PAGE).join(page_sizes, PAGE, "left").where(F.col("top") <= TITLE_ZONE * F.coalesce("page_h", F.lit(800.0)))
    found = layout.title_candidate(top).join(first.select("doc_id", "middle"), "doc_id")
    return found.where(F.col("size") >= TITLE_SIZE * F.col("middle")).select("doc_id", "candidate")


@dataclass(frozen=True)
class Drawn:
    """What the PDF files of a scan draw, computed once: glyphs (with doc_id), errors, lines of the first engine, images, shapes and links."""

    files: DataFrame
    glyphs: DataFrame
    errors: DataFrame
    lines: DataFrame
    objects: DataFrame

    @classmethod
    def of(cls, keyed: DataFrame, options: Options) -> Drawn:
        pdfs = keyed.where("kind = 'pdf'")
        every = staged(options.glyphs(pdfs).withColumn("doc_id", F.xxhash64("path")))
        glyphs = every.where("error is null")
        errors = every.where("error is not null").groupBy("doc_id").agg(F.min("error").alias("error"))
        sizes = glyphs.groupBy(*PAGE).agg(F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"))
        objects = staged(options.objects(pdfs).withColumn("doc_id", F.xxhash64("path")).join(sizes, PAGE, "left"))
        return cls(keyed, glyphs, errors, staged(stream.read_stream(glyphs)), objects)

    def page_sizes(self) -> DataFrame:
        return self.glyphs.groupBy(*PAGE).agg(F.max("page_h").alias("page_h"))


def texts(drawn: Drawn, options: Options = Options()) -> DataFrame:
    """path, doc_id, media, text, text_source, error, candidate, found_captions, links of files (path, kind, media, content). kind text: the content itself as UTF-8.

    A file's plain text is only asked for where its layout text is no good; a layout text that is short or long is still taken if there is no other. Captions, title and links are those of the layout."""
    keyed = drawn.files
    blocks = stream_blocks(drawn.lines)
    read = keyed.select("path", "doc_id", "kind", "media", F.when(F.col("kind") == "text", F.decode("content", "utf-8")).alias("own")).join(headed_text(blocks), "doc_id", "left")
    good = staged(files.raw_text(read.withColumns(dict.fromkeys(("plain_text", "ocr_text", "cached_text"), F.lit(None).cast("string"))), any_length=False).where("text is not null").select("doc_id"))
    plain = options.plain(keyed.where("kind = 'pdf'").join(good, "doc_id", "left_anti")).select(F.xxhash64("path").alias("doc_id"), "plain_text")
    seen = options.ocr(keyed.where("kind != 'text'")).select("doc_id", "ocr_text")
    x = read.join(drawn.errors, "doc_id", "left").join(seen, "doc_id", "left").join(plain, "doc_id", "left")
    x = files.raw_text(x.withColumn("cached_text", F.lit(None).cast("string")))
    x = x.withColumns({"text": F.coalesce("own", "text"), "text_source": F.when(F.col("own").isNotNull(), "file").otherwise(F.col("text_source"))})
    links = drawn.objects.where("kind = 'link' and uri is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "top", "x0", "uri"))).alias("l"))
    x = x.join(links.select("doc_id", F.array_distinct(F.transform("l", lambda y: y["uri"])).alias("links")), "doc_id", "left")
    x = x.join(title_candidates(drawn.lines, drawn.page_sizes()), "doc_id", "left").join(found_captions(blocks, drawn.objects), "doc_id", "left")
    by_layout = F.col("text_source") == "layout"
    return x.select(
        "path", "doc_id", "media", "text", "text_source", F.coalesce("error", F.when(F.col("text").isNull(), "no text could be read")).alias("error"),
        F.when(F.col("text_source").isin("layout", "plain"), F.col("candidate")).alias("candidate"), F.when(by_layout, F.col("found_captions")).alias("found_captions"), "links",
    )


def _with_fallback(read: DataFrame, drawn: Drawn, options: Options) -> tuple[DataFrame, DataFrame]:
    """read with the text and captions of the better engine, and its answers: doc_id, response. The second engine sees runaway documents only."""
    second: list[DataFrame] = []

    def other(ids: DataFrame) -> DataFrame:
        second.append(staged(cut_blocks(drawn.glyphs.join(ids, "doc_id", "left_semi"))))
        return headed_text(second[0]).select("doc_id", document.cleaned_text("layout_text").alias("text"))

    cleaned = read.withColumn("text", document.cleaned_text("text"))
    chosen = staged(attempts.with_fallback(cleaned, options.structurer, other, F.col("text_source") == "layout"))
    again = chosen.where("engine = 'second'").select("doc_id", F.col("text").alias("_text"))
    captions = found_captions(second[0].join(again, "doc_id", "left_semi"), drawn.objects.join(again, "doc_id", "left_semi")).withColumnRenamed("found_captions", "_captions")
    x = read.join(again, "doc_id", "left").join(captions, "doc_id", "left")
    x = x.withColumns({"found_captions": F.when(F.col("_text").isNotNull(), F.col("_captions")).otherwise(F.col("found_captions")), "text_source": F.when(F.col("_text").isNotNull(), "second layout").otherwise(F.col("text_source")), "text": F.coalesce("_text", "text")})
    return x.drop("_text", "_captions"), chosen.select("doc_id", "response")


def records(spark: SparkSession, source: str, patterns: str = "*.pdf,*.png,*.jpg,*.jpeg,*.txt,*.md", options: Options = Options()) -> DataFrame:
    """path, json, report, text_source, error: a record for each file that meets the patterns; files without text have an error and no json."""
    found = files.scan(spark, source, patterns).withColumn("kind", F.when(files.ending(F.col("path")).isin(".txt", ".md"), "text").otherwise(F.col("kind"))).where("kind is not null")
    return recorded(found, options)


def recorded(found: DataFrame, options: Options = Options()) -> DataFrame:
    """records() of files that were found already (path, kind, media, content)."""
    drawn = Drawn.of(found.withColumn("doc_id", F.xxhash64("path")), options)
    read = staged(texts(drawn, options))
    good = read.where("error is null")
    if options.layout_fallback:
        good, answers = _with_fallback(good, drawn, options)
        options = replace(options, structurer=lambda docs: docs.select("doc_id").join(answers, "doc_id"))
    good = staged(good)
    made = document.record_texts(document.documents(good, options), options)
    files_ = read.select("path", "doc_id", "error").join(good.select("doc_id", "text_source"), "doc_id", "left")
    return files_.join(made.select("doc_id", "json", "report"), "doc_id", "left").drop("doc_id")

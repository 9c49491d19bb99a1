"""Interfaces to what Spark does not do itself: glyphs of PDF files, text recognition, text models, web registries.

Each is a function from DataFrame to DataFrame, so that a plan takes any. The defaults work offline: they use libraries where these can be imported
and leave their columns null where not; the structurer without a model takes sections from headers."""

from __future__ import annotations

import importlib.util
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import lines

GLYPHS = "path string, page int, si int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string, upright boolean, matrix array<double>, page_w double, page_h double, error string"
Step = Callable[[DataFrame], DataFrame]


def pdf_glyphs(files: DataFrame) -> DataFrame:
    """Glyphs of PDF files (path, content); a file that cannot be read is one row with its error; no rows where no PDF library is installed with the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in GLYPHS.split(", ")]
        if importlib.util.find_spec("pdfplumber") is None:
            for _ in batches:
                yield pd.DataFrame(columns=names)
            return
        import io

        import pdfplumber

        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    with pdfplumber.open(io.BytesIO(content)) as pdf:
                        for n, page in enumerate(pdf.pages, 1):
                            rows = [(path, n, i, c["text"], c["x0"], c["x1"], c["top"], c["bottom"], c["size"], c["fontname"], c["upright"], list(c.get("matrix") or ()) or None, float(page.width), float(page.height), None) for i, c in enumerate(page.chars)]
                            yield pd.DataFrame(rows, columns=names)
                except Exception as e:  # a damaged file must not end the others
                    yield pd.DataFrame([(path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"[:300])], columns=names)

    return files.select("path", "content").mapInPandas(run, GLYPHS)


OBJECTS = "path string, page int, kind string, x0 double, top double, x1 double, bottom double, uri string"


def _of_each(files: DataFrame, library: str, schema: str, rows: Callable[[object, str, bytes], list[tuple]]) -> DataFrame:
    """rows(library, path, content) of each file; a file that cannot be read gives none (its glyphs name the error), as do all where the library is missing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        found = importlib.import_module(library) if importlib.util.find_spec(library) else None
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    got = rows(found, path, content) if found else []
                except Exception:  # a damaged file must not end the others
                    got = []
                yield pd.DataFrame(got, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def pdf_objects(files: DataFrame) -> DataFrame:
    """Images, drawn shapes and links (with their addresses) of PDF files, page by page."""

    def rows(library: object, path: str, content: bytes) -> list[tuple]:
        import io

        out = []
        with library.open(io.BytesIO(content)) as pdf:
            for n, page in enumerate(pdf.pages, 1):
                for kind, items in (("image", page.images), ("rect", page.rects), ("line", page.lines), ("curve", page.curves), ("link", page.hyperlinks)):
                    out += [(path, n, kind, float(o["x0"]), float(o["top"]), float(o["x1"]), float(o["bottom"]), o.get("uri")) for o in items]
        return out

    return _of_each(files, "pdfplumber", OBJECTS, rows)


def pdf_plain(files: DataFrame) -> DataFrame:
    """path, plain_text: the text of all pages as the file stores it."""

    def rows(library: object, path: str, content: bytes) -> list[tuple]:
        with library.open(stream=content, filetype="pdf") as pdf:
            return [(path, "\n".join(page.get_text() for page in pdf))]

    return _of_each(files, "fitz", "path string, plain_text string", rows)


def no_ocr(files: DataFrame) -> DataFrame:
    return files.withColumn("ocr_text", F.lit(None).cast("string"))


def header_structurer(docs: DataFrame) -> DataFrame:
    """doc_id, response: JSON of a document's sections by its "## " lines, in the form that a text model gives."""
    found = lines.section_rows(lines.lines_of(docs))
    one = F.struct(F.col("pos"), F.struct(F.col("title").alias("sectionTitle"), F.col("content").alias("sectionContent")).alias("s"))
    grouped = found.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("sections"))
    return grouped.select("doc_id", F.to_json(F.struct(F.struct("sections").alias("content"))).alias("response"))


@dataclass
class Budget:
    """Seconds of waiting that several lookups share."""

    seconds: float


@dataclass(frozen=True)
class Retry:
    """Attempts and waits for a web lookup in one task; a budget of seconds for all waits."""

    attempts: int = 3
    waits: tuple[float, ...] = (1.0, 2.0)
    budget: float = 30.0
    again: frozenset[int] = frozenset((0, 408, 429, 500, 502, 503, 504))

    def run(self, call: Callable[[], tuple[int, object]], budget: Budget, sleep: Callable[[float], None] = time.sleep) -> tuple[int, object]:
        """The last status and answer of call() -> (status, answer): after a refusal, or once attempts or budget are used up, that of the failure."""
        for i in range(self.attempts):
            status, answer = call()
            wait = self.waits[min(i, len(self.waits) - 1)]
            if status == 200 or status not in self.again or i == self.attempts - 1 or wait > budget.seconds:
                break
            sleep(wait)
            budget.seconds -= wait
        return status, answer

    def get(self, call: Callable[[], tuple[int, object]], spent: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> object | None:
        """The answer of run() with what is left of the budget; None if it failed."""
        status, answer = self.run(call, Budget(self.budget - spent), sleep)
        return answer if status == 200 else None


@dataclass(frozen=True)
class Options:
    """What a plan takes from outside: steps and switches."""

    structurer: Step = header_structurer
    ocr: Step = no_ocr
    glyphs: Step = pdf_glyphs
    objects: Step = pdf_objects
    plain: Step = pdf_plain
    orgs: DataFrame | None = None
    persons: DataFrame | None = None
    lookups: Step | None = None  # from names of affiliations and funders (name) to a registry, where orgs is not given
    schema_address: str | None = None
    extract_identifiers: bool = False
    ground_headers: bool = True
    reclaim_lines: bool = True
    layout_fallback: bool = True

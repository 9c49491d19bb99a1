"""Blocks of a page from its glyphs in the order in which they were drawn: words, lines, paragraphs, reading order.

One call for each page (applyInPandas); a page never leaves its task. Work grows with the number of glyphs, but for the order of
blocks, which compares blocks of a page with its few wide ones. Distances are in units of the text's size, so drawings of any scale are
read alike; positions are taken along and across the direction of writing."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame

from lectern.operators import pages

# Tolerances, in sizes unless said otherwise.
OUTSIDE = 2.0  # points that an origin may lie beyond the page
SHIFT = 1.0  # points by which the baseline may change within a word
GAP, BACK = 0.10, 0.30  # a gap over GAP is a blank; a step back over BACK begins a word
TWICE_ALONG, TWICE_ACROSS = 0.10, 0.20  # glyphs drawn twice
TURN, SNAP = 3.0, 1.0  # degrees: one direction of writing; snapped to right angles
ROW, STACK, FAR = 0.5, 0.1, 1.5  # one row; overlap of words on top of each other; next word of a line
SIZE_DIFFERS, LEADING, BULLET_LEADING, JUMP = 0.05, 1.5, 2.6, 0.3
REACH, SCRIPT = 0.8, 0.97  # accents; a script is smaller than this
HEADING_LINES, HEADING_BOLD, HEADING_NEXT = 3, 0.95, 3
CHAIN, PIECE, EVEN = 6, 2, 1.5  # letter-spaced text: pieces of a chain, characters of a piece, letter gaps against the typical one
BESIDE, BELOW = 6.0, 3.0  # side labels
CLOSERS = frozenset(",;.:)]}")
CONTACT = re.compile(r"@\w|orcid|https?://|www\.", re.I)
BULLET = re.compile(r"^(?:[•▪●◦‣∙·*–-]|\d{1,2}[.)])(?:\s|$)")
# Accents that are drawn beside their letters, and their combining forms where NFKC has none.
PLAIN_ACCENTS = {"^": "̂", "`": "̀", "~": "̃"}
ACCENTS = {c: unicodedata.normalize("NFKD", c)[-1] for c in "¨¯´¸˘˙˚˛˜˝"} | {"ˆ": "̂", "ˇ": "̌"} | PLAIN_ACCENTS


@dataclass(slots=True)
class Glyph:
    text: str
    start: float  # along the direction of writing
    end: float
    base: float  # across it; grows downwards
    size: float
    angle: float
    bold: bool
    font: str
    box: tuple[float, float, float, float]


@dataclass(slots=True)
class Word:
    glyphs: list[Glyph]
    spaced: bool  # a blank or a gap stands before it
    gap: float = -1.0  # the gap alone that parts it from the word before on its line, in sizes

    @property
    def text(self) -> str:
        return "".join(g.text for g in self.glyphs)


@dataclass(slots=True)
class Line:
    words: list[Word] = field(default_factory=list)
    start: float = 0.0
    end: float = 0.0
    base: float = 0.0
    size: float = 0.0
    angle: float = 0.0
    text: str = ""

    def glyphs(self) -> Iterator[Glyph]:
        return (g for w in self.words for g in w.glyphs)


@dataclass(slots=True)
class Block:
    lines: list[Line]
    bold: bool = False
    box: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    size: float = 0.0


def _number(x: object) -> float | None:
    return float(x) if isinstance(x, (int, float)) and math.isfinite(x) else None


def prepared(rows: Iterable[dict], width: float, height: float, left: float = 0.0, top: float = 0.0) -> list[Glyph | None]:
    """Glyphs in order; None where a word ends: a blank, an unknown character, a glyph off the page, or one with damaged numbers.

    rows: text, and x0, x1, top, bottom, size, fontname, matrix (a, b, c, d, e, f with f upwards) as far as they are there. Missing ones are made
    from the others; present ones that are no numbers make the glyph a damaged one. left, top: where the page's box begins, for x0 and the like."""
    return [_glyph(r, width, height, left, top) for r in rows]


def _glyph(r: dict, width: float, height: float, left: float, top: float) -> Glyph | None:
    text = r.get("text") or ""
    if not text.strip() or text.startswith("(cid:"):
        return None
    matrix = r.get("matrix")
    there = matrix is not None and not (isinstance(matrix, float) and math.isnan(matrix))
    m = [_number(x) for x in matrix] if there else None
    if m is not None and (len(m) != 6 or None in m):
        return None
    box = {k: r[k] for k in ("x0", "x1", "top", "bottom") if k in r}
    size = r.get("size", 0.0)
    given = [_number(x) for x in box.values()]
    if box and (len(box) < 4 or None in given) or _number(size) is None:
        return None
    if not box and m is None:
        return None
    size = float(size) if size > 0 else math.hypot(m[2], m[3]) if m and math.hypot(m[2], m[3]) > 0 else box["bottom"] - box["top"]
    if size <= 0:
        return None
    if m is not None:
        x, y = m[4], height - m[5]
        angle = math.degrees(math.atan2(-m[1], m[0]))
    else:
        x, y, angle = box["x0"] - left, box["bottom"] - 0.25 * size - top, 0.0 if r.get("upright") is not False else 270.0
    angle = round(angle / 90) * 90.0 if abs(angle - round(angle / 90) * 90) <= SNAP else angle
    angle %= 360
    if not (-OUTSIDE <= x <= width + OUTSIDE and -OUTSIDE <= y <= height + OUTSIDE):
        return None
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    own = (box["x0"] - left, box["top"] - top, box["x1"] - left, box["bottom"] - top) if box else (x, y - 0.75 * size, x + 0.5 * size, y + 0.25 * size)
    advance = _number(r.get("adv")) or (own[2] - own[0] if angle % 180 == 0 else own[3] - own[1])
    start = x * c + y * s
    font = r.get("fontname") or ""
    return Glyph(text, start, start + advance, y * c - x * s, size, angle, bool(re.search("bold|black|heavy", font, re.I)), font, own)


def without_twice(items: list[Glyph | None]) -> list[Glyph | None]:
    """Without glyphs drawn again at nearly the same place: one text, font, size and direction."""
    seen: dict[tuple, list[Glyph]] = defaultdict(list)
    out: list[Glyph | None] = []
    for g in items:
        if g is not None:
            cell = max(TWICE_ACROSS * g.size, 0.1)
            key = (g.text, g.font, round(g.size, 1), g.angle)
            i, j = int(g.start // cell), int(g.base // cell)
            near = (o for a in (-1, 0, 1) for b in (-1, 0, 1) for o in seen.get((*key, i + a, j + b), ()))
            if any(abs(o.start - g.start) <= TWICE_ALONG * g.size and abs(o.base - g.base) <= TWICE_ACROSS * g.size for o in near):
                continue
            seen[(*key, i, j)].append(g)
        out.append(g)
    return out


def _accented(mark: Glyph, letter: Glyph) -> bool:
    """Whether the mark belongs on the letter: over or under it, by their boxes, and off its baseline if it is a plain character."""
    size = max(mark.size, letter.size)
    inside = min(mark.end, letter.end) - max(mark.start, letter.start)
    off = letter.base - mark.base
    plain = mark.text in PLAIN_ACCENTS
    return mark.angle == letter.angle and letter.text[:1].isalpha() and len(letter.text) == 1 and abs(off) <= REACH * size and inside >= 0.3 * min(mark.end - mark.start, letter.end - letter.start) and (not plain or off >= 0.1 * size)


def with_accents(items: list[Glyph | None]) -> list[Glyph | None]:
    """Accents drawn right before or after their letters become marks of them; a letter takes one, others drawn on it go."""
    out: list[Glyph | None] = []
    waiting: list[Glyph] = []  # accents that may belong to the next letter
    marked: set[int] = set()

    def give(mark: Glyph, letter: Glyph) -> None:
        if id(letter) not in marked:
            letter.text = unicodedata.normalize("NFC", letter.text + ACCENTS[mark.text])
            marked.add(id(letter))

    for g in items:
        if g is not None and g.text in ACCENTS:
            before = out[-1] if out and not waiting else None
            if before is not None and _accented(g, before):
                give(g, before)
            else:
                waiting.append(g)
            continue
        for w in waiting:
            if g is not None and _accented(w, g):
                give(w, g)
            else:
                out.append(w)
        waiting = []
        out.append(g)
    return out + waiting


def words(items: list[Glyph | None]) -> list[Word]:
    out: list[Word] = []
    blank = True
    for g in items:
        if g is None:
            blank = True
            continue
        last = out[-1].glyphs[-1] if out else None
        if last is not None and not blank:
            size = max(g.size, last.size)
            step = g.start - last.end
            same = abs((g.angle - last.angle + 180) % 360 - 180) <= TURN and abs(g.base - last.base) <= SHIFT
            if same and -BACK * size <= step <= GAP * size or _raised_sign(last, g) or _raised_sign(g, last):
                out[-1].glyphs.append(g)
                continue
            blank = same and step > GAP * size
            out.append(Word([g], blank, step / size if blank else -1.0))
        else:
            out.append(Word([g], blank))
        blank = False
    return rejoined(out)


def rejoined(found: list[Word]) -> list[Word]:
    """Words whose letters are drawn apart, as words again.

    In a chain of short pieces that only gaps part, the gaps between letters are near the typical small gap (the lower quartile), those between words clearly
    larger. A chain of even gaps says nothing of words and stays as it is; so does what a blank parts."""
    out: list[Word] = []
    for _, chain in groupby(_chained(found), lambda x: x[0]):
        pieces = [w for _, w in chain]
        gaps = sorted(w.gap for w in pieces[1:])
        most = EVEN * gaps[(len(gaps) - 1) // 4] if gaps else 0.0
        if len(pieces) < CHAIN or most <= 0 or gaps[-1] <= most:
            out += pieces
            continue
        for i, w in enumerate(pieces):
            if i and w.gap <= most:
                out[-1].glyphs.extend(w.glyphs)
            else:
                out.append(w)
    return out


def _chained(found: list[Word]) -> Iterator[tuple[int, Word]]:
    """Words with the number of their chain: short pieces of one direction, each parted from the one before by a gap."""
    n, before = 0, None
    for w in found:
        short = len(w.text) <= PIECE
        if before is None or not (short and len(before.text) <= PIECE and w.gap >= 0 and w.glyphs[0].angle == before.glyphs[0].angle):
            n += 1
        yield n, w
        before = w


def _raised_sign(sign: Glyph, other: Glyph) -> bool:
    """A plain accent that stands raised over the edge of a neighbour that takes no accent, as in a power."""
    return sign.text in PLAIN_ACCENTS and sign.angle == other.angle and abs(sign.base - other.base) <= REACH * other.size and min(sign.end, other.end) - max(sign.start, other.start) > 0


def lines(found: list[Word]) -> list[Line]:
    out: list[Line] = []
    for w in found:
        first, last = w.glyphs[0], w.glyphs[-1]
        now = out[-1] if out else None
        if now is None or not _goes_on(now, w):
            out.append(Line([w], first.start, last.end, first.base, first.size, first.angle))
            continue
        now.words.append(w)
        now.start, now.end = min(now.start, first.start), max(now.end, last.end)
        if first.size > now.size * 1.02:  # what came before were scripts
            now.size, now.base = first.size, first.base
    for x in out:
        _join(x)
    return out


def _goes_on(line: Line, w: Word) -> bool:
    first, last = w.glyphs[0], w.glyphs[-1]
    size = max(line.size, first.size)
    if abs((first.angle - line.angle + 180) % 360 - 180) > TURN or abs(first.base - line.base) > ROW * size or first.start > line.end + FAR * size:
        return False
    tail = line.words[-1].glyphs
    if first.start < line.end - size and first.start < tail[0].start:
        return False  # reading has gone back
    stacked = min(line.end, last.end) - max(tail[0].start, first.start)
    return abs(first.base - line.base) <= SHIFT or first.size < SCRIPT * line.size or line.size < SCRIPT * first.size or stacked <= STACK * size


def _join(line: Line) -> None:
    """The line's text: blanks where they were drawn, before raised words and after them, none before closing signs or lowered words."""
    parts: list[str] = []
    right, raised = 0.0, False
    for i, w in enumerate(line.words):
        g = w.glyphs[0]
        up = line.base - g.base > 0.05 * line.size and g.size < SCRIPT * line.size
        down = g.base - line.base > 0.05 * line.size and g.size < SCRIPT * line.size
        gap = g.start - right > GAP * line.size
        if i and not down and (w.spaced or gap or up != raised) and not (w.text[0] in CLOSERS and not w.spaced):
            parts.append(" ")
        elif i and down and w.spaced:
            parts.append(" ")
        parts.append(w.text)
        right, raised = max(right, w.glyphs[-1].end) if i else w.glyphs[-1].end, up
    line.text = unicodedata.normalize("NFC", " ".join(pages.logical("".join(parts).split(" "))))


def _is_bold(line: Line) -> bool:
    n = [(len(g.text), g.bold) for g in line.glyphs()]
    return sum(k for k, b in n if b) >= HEADING_BOLD * sum(k for k, _ in n)


def blocks(found: list[Line], page_w: float, split_headings: bool = True) -> list[Block]:
    """Lines in order as paragraphs. Where the stream jumps between columns, each lane has an open paragraph of its own."""
    flat = [{"line_no": i, "x0": x.start, "x1": x.end, "bottom": x.base, "size": x.size} for i, x in enumerate(found) if x.angle == 0.0]
    lane = pages.lanes(flat, page_w)
    open_: dict[int | None, Block] = {}
    out: list[Block] = []
    for i, x in enumerate(found):
        b = open_.get(lane.get(i))
        if b is None or not _continues(b, x, split_headings):
            b = Block([])
            out.append(b)
            open_[lane.get(i)] = b
        b.lines.append(x)
    for b in out:
        boxes = [g.box for x in b.lines for g in x.glyphs()]
        b.box = (min(q[0] for q in boxes), min(q[1] for q in boxes), max(q[2] for q in boxes), max(q[3] for q in boxes))
        sizes: dict[float, int] = defaultdict(int)
        chars = bold = 0
        for x in b.lines:
            for g in x.glyphs():
                sizes[round(g.size, 1)] += len(g.text)
                chars, bold = chars + len(g.text), bold + len(g.text) * g.bold
        b.size, b.bold = max(sizes, key=lambda k: (sizes[k], k)), 2 * bold > chars
    return out


def _continues(b: Block, x: Line, split_headings: bool) -> bool:
    last = b.lines[-1]
    if x.angle != last.angle or abs(x.size / last.size - 1) > SIZE_DIFFERS:
        return False
    step = x.base - last.base
    if abs(step) <= ROW * last.size:  # one row
        return x.start >= last.end and not (_is_bold(x) and _is_bold(last) and x.start - last.end > BELOW * last.size)
    bullets = BULLET.match(x.text) and BULLET.match(b.lines[0].text)
    if not 0 < step <= (BULLET_LEADING if bullets else LEADING) * last.size:
        return False
    left, right = min(q.start for q in b.lines), max(q.end for q in b.lines)
    if len(b.lines) == 1 and x.start > right + JUMP * last.size or x.end < left:
        return False
    heading = split_headings and len(b.lines) <= HEADING_LINES and all(map(_is_bold, b.lines)) and not _is_bold(x)
    return not (heading and sum(c.isalnum() for c in x.text) >= HEADING_NEXT and not CONTACT.search(x.text))


def ordered(found: list[Block]) -> list[Block]:
    """Blocks as they are read, by pages.reading_order(); then labels in the margin before what they name."""
    boxes = [dict(zip(("x0", "y0", "x1", "y1"), b.box, strict=True)) | {"seq": i, "line_h": b.lines[0].size} for i, b in enumerate(found)]
    return _beside([found[b["seq"]] for b in pages.reading_order(boxes)])


def _beside(found: list[Block]) -> list[Block]:
    """Labels in the margin, bold or larger, go right before the text that they stand left of, if no text of their own is under them."""
    out = list(found)
    for b in found:
        x0, y0, x1, y1 = b.box
        if len(b.lines) > 2 or not (b.bold or b.size > 1.1 * min(q.size for q in found)):
            continue
        named = [q for q in found if q is not b and 0 <= q.box[0] - x1 <= BESIDE * b.size and q.box[1] - 0.5 * b.size <= y0 and y1 <= q.box[3] + 0.5 * b.size and q.box[3] - q.box[1] >= y1 - y0 and q.box[2] - q.box[0] > x1 - x0 and (b.bold or b.size > 1.1 * q.size)]
        own = any(q is not b and y1 - 1e-6 <= q.box[1] <= y1 + BELOW * (y1 - y0) and min(q.box[2], x1) - max(q.box[0], x0) >= 0.3 * min(q.box[2] - q.box[0], x1 - x0) for q in found)
        if named and not own:
            target = min(named, key=lambda q: (q.box[0] - x1, q.box[1]))
            out = [q for q in out if q is not b]
            out.insert(next(i for i, q in enumerate(out) if q is target), b)
    return out


def page_blocks(rows: Iterable[dict], width: float, height: float, left: float = 0.0, top: float = 0.0, split_headings: bool = True) -> list[Block]:
    return ordered(blocks(lines(words(with_accents(without_twice(prepared(rows, width, height, left, top))))), width, split_headings))


STREAM = "doc_id long, page int, block_no int, line_no int, text string, x0 double, top double, x1 double, bottom double, size double, bold boolean, engine string"


def read_stream(glyphs: DataFrame, width: float = 600.0, height: float = 800.0) -> DataFrame:
    """Lines of all pages in reading order, with their blocks. glyphs: doc_id, page, si, text, x0, x1, top, bottom, size, fontname; optional matrix, page_w, page_h.

    A page on which this fails is read by the recursive cut instead (engine: stream, or cut)."""

    def one(page: list[dict]) -> list[tuple]:
        w, h = pages.first(page, "page_w", width), pages.first(page, "page_h", height)
        try:
            got: list[tuple] = []
            for i, b in enumerate(page_blocks(page, w, h)):
                for x in b.lines:
                    boxes = [g.box for g in x.glyphs()]
                    got.append((i, len(got), x.text, min(q[0] for q in boxes), min(q[1] for q in boxes), max(q[2] for q in boxes), max(q[3] for q in boxes), x.size, _is_bold(x), "stream"))
            return got
        except (ArithmeticError, LookupError, TypeError, ValueError):
            # Of line_rows(): the number, region, text, x0, x1, top, bottom, size, bold.
            return [(r[1], r[0], r[2], r[3], r[5], r[4], *r[6:], "cut") for r in pages.line_rows(page, w, h)]

    return pages.by_page(glyphs, one, STREAM, "si")

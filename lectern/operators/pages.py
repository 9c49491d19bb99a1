"""Page layout that depends on what came before: one call for each page, over the sorted rows of a partition. A page never leaves its task."""

from __future__ import annotations

import math
import re
import statistics
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Thresholds of the recursive cut, in font sizes.
GAP_AREA, GAP_SIZE, CHUNK, SLACK, DEEPEST = 3.0, 0.2, 2.0, 0.2, 50
WIDE, BOTTOM, DESCENT = 0.7, 0.65, 0.35
# Thresholds of figure masks, as shares of the page.
IMAGE_LEAST, MASK_LEAST, MASK_MOST, CLUSTER, PANEL_CHILDREN = 0.005, 0.0005, 0.25, 4, 3


def _gaps(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    spans = sorted(spans)
    out, end = [], spans[0][1]
    for a, b in spans[1:]:
        if a > end + 0.01:
            out.append(((end + a) / 2, a - end))
        end = max(end, b)
    return out


class Region:
    """A node of the cut: leaves hold glyphs, others children, side by side (across) or one below the other."""

    def __init__(self, glyphs: list[dict], parts: list[Region] | None = None, across: bool = False):
        self.glyphs, self.parts, self.across = glyphs, parts or [], across
        boxes = [p.box for p in self.parts] or [(g["x0"], g["top"], g["x1"], g["bottom"]) for g in glyphs] or [(0.0,) * 4]
        self.box = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))

    def leaves(self, path: tuple[int, ...] = ()):
        """Leaves in reading order with the columns on the way to them."""
        if not self.parts:
            yield self, path
        for i, p in enumerate(self.parts):
            yield from p.leaves((*path, i) if self.across else path)


def cut(glyphs: list[dict], depth: int = 0) -> Region:
    """Columns are cut at gaps as wide as the widest, if it is wide for the block's height and the chunks are not slivers; else rows."""
    region = Region(glyphs)
    if len(glyphs) < 3 or depth > DEEPEST:
        return region
    x0, y0, x1, y1 = region.box
    sizes = [g["size"] for g in glyphs]
    mean, least = max(statistics.fmean(sizes), 0.1), max(min(sizes), 0.1)
    for across, a, b, length, far in ((True, "x0", "x1", y1 - y0, (x0, x1)), (False, "top", "bottom", x1 - x0, (y0, y1))):
        if across and y1 - y0 < 1.5 * mean:
            continue
        gaps = _gaps([(g[a], g[b]) for g in glyphs])
        widest = max((g[1] for g in gaps), default=0.0)
        if widest <= GAP_SIZE * least or widest <= GAP_AREA * mean**2 / max(length, 0.1):
            continue
        cuts = sorted(m for m, w in gaps if w > widest - SLACK * mean)
        bounds = [far[0], *cuts, far[1]]
        if across and min(q - p for p, q in zip(bounds, bounds[1:])) <= CHUNK * mean:
            continue
        parts: dict[int, list[dict]] = defaultdict(list)
        for g in glyphs:
            at = (g["x0"] + g["x1"]) / 2 if across else g["bottom"] - DESCENT * (g["bottom"] - g["top"])
            parts[bisect_right(cuts, at)].append(g)
        if len(parts) > 1:
            return Region([], [cut(parts[k], depth + 1) for k in sorted(parts)], across)
    return region


def arranged(r: Region, page_w: float, page_h: float) -> Region:
    """Wide leaves leave the columns they were cut into; columns at the foot of the page are read by height."""
    if not r.parts:
        return r
    parts = [arranged(p, page_w, page_h) for p in r.parts]
    if not r.across:
        return Region([], parts, False)
    wide = {id(p) for p in parts if not p.parts and p.box[2] - p.box[0] > WIDE * page_w}
    by_top = sorted(parts, key=lambda p: p.box[1])
    if r.box[1] >= BOTTOM * page_h and len(parts) > 1:
        return Region([], by_top, False)
    if not wide or len(wide) == len(parts):
        return Region([], parts, True)
    rows: list[Region] = []
    held: list[Region] = []
    for p in [*by_top, None]:
        if p is not None and id(p) not in wide:
            held.append(p)
            continue
        if held:
            rows.append(held[0] if len(held) == 1 else Region([], held, True))
            held = []
        if p is not None:
            rows.append(p)
    return Region([], rows, False)


def lines_of(glyphs: list[dict], size: float) -> list[list[dict]]:
    """Lines by the running mean of their baselines; small raised or lowered glyphs join the line beside them first."""
    main = [g for g in glyphs if g["size"] >= 0.8 * size] or glyphs
    small = [g for g in glyphs if g["size"] < 0.8 * size] if len(main) < len(glyphs) else []
    out: list[list[dict]] = []
    base = 0.0
    for g in sorted(main, key=lambda g: (g["bottom"], g["x0"])):
        if out and abs(g["bottom"] - base) <= 0.5 * max(size, 1.0):
            out[-1].append(g)
            base += (g["bottom"] - base) / len(out[-1])
        else:
            out.append([g])
            base = g["bottom"]
    alone = []
    for g in small:
        best = None
        for line in out:
            top, bottom = min(c["top"] for c in line), max(c["bottom"] for c in line)
            inside = (min(bottom, g["bottom"]) - max(top, g["top"])) / max(g["bottom"] - g["top"], 0.1)
            gap = min(max(c["x0"] - g["x1"], g["x0"] - c["x1"], 0.0) for c in line)
            if inside >= 0.5 and gap <= 0.5 * size:
                key = (gap, -inside)
                if best is None or key < best[0]:
                    best = (key, line)
        (best[1] if best else alone).append(g)
    if alone:
        out += lines_of(alone, statistics.median(g["size"] for g in alone))
    return [sorted(line, key=lambda g: (g["x0"], g["x1"])) for line in sorted(out, key=lambda line: min(g["bottom"] for g in line))]


def words_of(line: list[dict], tol: float) -> list[list[dict]]:
    """Glyphs of a line in words: parted by gaps over tol, blanks, steps back, and steps between small and normal size."""
    mode = Counter(round(g["size"] * 2) / 2 for g in line).most_common(1)[0][0]
    out: list[list[dict]] = []
    right, before, blank = -math.inf, None, False
    for g in line:
        if not g["text"].strip():
            blank = True
            continue
        small = g["size"] < 0.8 * mode
        if not out or blank or g["x0"] - right > tol or small != (before["size"] < 0.8 * mode) or g["x1"] < before["x0"] - tol:
            out.append([])
            right = -math.inf
        out[-1].append(g)
        right, before, blank = max(right, g["x1"]), g, False
    return out


def without_overprints(glyphs: list[dict], tol: float = 1.0) -> list[dict]:
    """The first of glyphs with the same text, font and size within tol of each other, found in a grid of cells."""
    seen: dict[tuple, list[tuple[float, float]]] = defaultdict(list)
    out = []
    for g in glyphs:
        key = (g["text"], g.get("fontname"), round(g["size"], 1))
        cx, cy = int(g["x0"] // (2 * tol)), int(g["top"] // (2 * tol))
        near = (p for i in (-1, 0, 1) for j in (-1, 0, 1) for p in seen.get((*key, cx + i, cy + j), ()))
        if not g["text"].strip() or not any(abs(p[0] - g["x0"]) <= tol and abs(p[1] - g["top"]) <= tol for p in near):
            seen[(*key, cx, cy)].append((g["x0"], g["top"]))
            out.append(g)
    return out


def composed(word: str) -> str:
    """Spacing accents drawn beside a letter become marks of it; then composed."""
    marks = {"´": "́", "`": "̀", "¨": "̈", "^": "̂", "ˆ": "̂", "~": "̃", "˜": "̃", "¸": "̧", "˚": "̊", "ˇ": "̌"}
    w = re.sub("([´`¨ˆ˜¸˚ˇ])(\\w)", lambda m: m[2] + marks[m[1]], word)
    return unicodedata.normalize("NFC", w)


def logical(words: list[str]) -> list[str]:
    """Words of a line printed right to left, in reading order, when most of its letters are right-to-left."""
    kinds = [unicodedata.bidirectional(c) for w in words for c in w if c.isalpha()]
    rtl = sum(k in ("R", "AL") for k in kinds)
    if rtl * 2 <= len(kinds):
        return words
    return [w[::-1] if any(unicodedata.bidirectional(c) in ("R", "AL") for c in w) else w for w in reversed(words)]


def rotated_words(glyphs: list[dict], tol: float) -> list[str]:
    """Words of vertical text: strips by x, glyphs upwards, gaps over tol part words."""
    strips: list[list[dict]] = []
    for g in sorted(glyphs, key=lambda g: g["x0"]):
        if strips and g["x0"] < strips[-1][-1]["x1"]:
            strips[-1].append(g)
        else:
            strips.append([g])
    out = []
    for s in strips:
        s.sort(key=lambda g: -g["bottom"])
        word = ""
        for a, b in zip([None, *s], s):
            if a is not None and (a["top"] - b["bottom"] > tol or not b["text"].strip()):
                out.append(word)
                word = ""
            word += b["text"].strip()
        out.append(word)
    return [w for w in out if w]


def lanes(lines: list[dict], page_w: float) -> dict[int, int]:
    """Lane of each line where the stream jumps between columns: two lanes of three lines or more, runs under two lines on average, even steps inside."""
    narrow = [ln for ln in lines if ln["x1"] - ln["x0"] <= 0.6 * page_w]
    if len(narrow) < 6:
        return {}
    groups: list[list] = []
    for ln in sorted(narrow, key=lambda q: (q["x0"], q["line_no"])):
        g = groups[-1] if groups else None
        if g and min(g[1], ln["x1"]) - max(g[0], ln["x0"]) >= 0.5 * min(ln["x1"] - ln["x0"], g[1] - g[0]):
            g[1] = max(g[1], ln["x1"])
            g[2].append(ln)
        else:
            groups.append([ln["x0"], ln["x1"], [ln]])
    lane = {ln["line_no"]: i for i, g in enumerate(groups) for ln in g[2]}
    order = [lane[ln["line_no"]] for ln in sorted(narrow, key=lambda q: q["line_no"])]
    runs = 1 + sum(a != b for a, b in zip(order, order[1:]))
    big = [g[2] for g in groups if len(g[2]) >= 3]
    if len(big) < 2 or len(order) / runs >= 2:
        return {}
    for g in big:
        g.sort(key=lambda q: q["line_no"])
        steps = [0 < b["bottom"] - a["bottom"] < 1.5 * a["size"] for a, b in zip(g, g[1:])]
        if sum(steps) < 0.7 * len(steps):
            return {}
    return lane


def _groups(boxes: np.ndarray, gap: float) -> list[np.ndarray]:
    """Rows of boxes that touch each other, over others too, when each is widened by half the gap: flood fill from each box that is left."""
    free, out = np.ones(len(boxes), bool), []
    for seed in range(len(boxes)):
        if not free[seed]:
            continue
        free[seed], found, front = False, [seed], [seed]
        while front:
            x0, y0, x1, y1 = boxes[front.pop()]
            near = np.flatnonzero(free & (boxes[:, 0] <= x1 + gap) & (boxes[:, 2] >= x0 - gap) & (boxes[:, 1] <= y1 + gap) & (boxes[:, 3] >= y0 - gap))
            free[near] = False
            found += near.tolist()
            front += near.tolist()
        out.append(np.array(found))
    return out


def masks(images: list[tuple], shapes: list[tuple], page_w: float, page_h: float, body: float = 0.0) -> list[tuple[str, tuple]]:
    """Boxes of figures: images of a figure's size; and groups of shapes a body line apart at most. A group of CLUSTER shapes or more counts with its
    surroundings if it is no page background, one of fewer if its ink is large enough. Panels, which are boxes around several shapes, are not ink."""
    page = max(page_w * page_h, 1.0)

    def share(boxes: np.ndarray) -> np.ndarray:
        return np.prod(np.maximum(boxes[:, 2:] - boxes[:, :2], 0.0), axis=1) / page

    pictures, b = (np.array(sorted(x) if x is shapes else x, np.float64).reshape(-1, 4) for x in (images, shapes))
    size = share(pictures)
    out = [("image", tuple(x)) for x in pictures[(size >= IMAGE_LEAST) & (size <= MASK_MOST)].tolist()]
    b = b[(share(b) <= MASK_MOST) & ((b[:, 2:] - b[:, :2]).max(axis=1, initial=0.0) >= 1.0)]
    within = np.array([((b[:, :2] >= x[:2]) & (b[:, 2:] <= x[2:])).all(axis=1).sum() - 1 for x in b], np.int64)  # less the box itself
    b = b[(share(b) < MASK_LEAST) | (within < PANEL_CHILDREN)]
    for own in _groups(b, max(6.0, body)):
        many = len(own) >= CLUSTER
        around = np.concatenate([b[own, :2].min(axis=0), b[own, 2:].max(axis=0)])
        if many:
            around += 0.75 * body * np.array([-1, -1, 1, 1])
        if share(around[None])[0] <= MASK_MOST if many else share(b[own]).sum() >= MASK_LEAST:
            out.append(("graphic", tuple(around.tolist())))
    return out


# The bound on hops, the share of the text's width that a banner has, tops that count as equal (points, lines).
HOPS, BANNER, EQUAL_TOP, EQUAL_LINE = 512, 0.3, 0.5, 0.1


def rows_of(blocks: list[dict]) -> list[dict]:
    """Blocks from the top. Tops that follow each other within half a point, or a tenth of a line, are equal: the order of drawing decides."""
    out: list[list[dict]] = []
    last: dict | None = None
    for b in sorted(blocks, key=lambda b: (b["y0"], b["seq"])):
        if last is None or b["y0"] - last["y0"] > max(EQUAL_TOP, EQUAL_LINE * last["line_h"]):
            out.append([])
        out[-1].append(b)
        last = b
    return [b for row in out for b in sorted(row, key=lambda b: b["seq"])]


def bands_of(rows: list[dict]) -> list[int]:
    """A band number for each of rows_of(): blocks that overlap in height, within a line, with one before or after share a band; others are bands of their own."""
    top, end, line = (np.array([b[k] for b in rows], np.float64) for k in ("y0", "y1", "line_h"))
    reach = np.maximum.accumulate(end + line)
    later = np.minimum.accumulate((top - line)[::-1])[::-1]
    joined = np.zeros(len(rows), bool)
    joined[1:] |= (top[1:] <= reach[:-1]) | (top[1:] - top[:-1] <= line[1:])
    joined[:-1] |= (top[1:] <= (end + line)[:-1]) | (later[1:] <= top[:-1])
    new = np.ones(len(rows), bool)
    new[1:] = ~(joined[1:] & joined[:-1])
    return (np.cumsum(new) - 1).tolist()


def is_banner(p: dict, band: list[dict], width: float) -> bool:
    """A wide block over two or more columns that are side by side, none of which begins above it to its left or right."""
    if p["x1"] - p["x0"] < BANNER * width:
        return False
    if any(q["y0"] < p["y0"] - 1e-6 and (q["x1"] <= p["x0"] or q["x0"] >= p["x1"]) for q in band):
        return False
    under = [q for q in band if q is not p and q["y0"] >= p["y1"] - 1e-6 and 0 < min(p["x1"], q["x1"]) - max(p["x0"], q["x0"]) >= 0.5 * (q["x1"] - q["x0"])]
    return bool(under) and max(q["x0"] for q in under) >= min(under, key=lambda q: q["x0"])["x1"]


def reading_order(blocks: list[dict], most_hops: int = HOPS) -> list[dict]:
    """Blocks (x0, y0, x1, y1, line_h, seq) as they are read: band after band from the top. In a band each block is inserted before those at its end that
    lie wholly to its right, at most so many; a banner wholly above it holds it, and none goes before the page's first block."""
    if not blocks:
        return []
    rows = rows_of(blocks)
    width = max(b["x1"] for b in rows) - min(b["x0"] for b in rows)
    out: list[dict] = []
    for n, group in groupby(zip(bands_of(rows), rows, strict=True), lambda x: x[0]):
        band = [b for _, b in group]
        banner = cache(lambda i, band=band: is_banner(band[i], band, width))
        placed: list[int] = []
        for i, b in enumerate(band):
            lowest = max(int(n == 0), len(placed) - most_hops)
            holds = (at for at in range(len(placed), lowest, -1) if band[placed[at - 1]]["x0"] <= b["x1"] or band[placed[at - 1]]["y1"] <= b["y0"] and banner(placed[at - 1]))
            placed.insert(min(next(holds, lowest), len(placed)), i)
        out += [band[i] for i in placed]
    return out


def grown_captions(blocks: list[dict], beside: dict[int, tuple[str, float]], body: float, most: int = 12) -> list[dict]:
    """Captions of a page: labelled blocks, then sentences in body size or smaller beside a region; each with the blocks that go on below it."""
    label = re.compile(r"^\W*(fig(?:ure)?s?|tab(?:le)?s?)\.?\s*(?:(S?\d+[A-Za-z]?|[IVX]{1,4})\b\s*[.:|–—-]?|[.:|])", re.I)
    never = re.compile(r"supported by|funded by|\bfunding\b|copyright|©|rights reserved|acknowledg|\bthank|\bcontact|correspondence|\be-?mail\b", re.I)
    used: set[int] = set()
    out = []
    for source in ("label", "geometry"):
        for i, b in enumerate(blocks):
            m = label.match(b["text"])
            if i in used or source == "label" and (not m or b["fontsize"] > 1.35 * body):
                continue
            if source == "geometry" and (m or b["block_no"] not in beside or never.search(b["text"]) or b["fontsize"] > 1.05 * body or len(b["text"].split()) < 6 or not re.search(r"\b[a-z]{2,}", b["text"])):
                continue
            chain = [i]
            while len(chain) < most:
                p = blocks[chain[-1]]
                nxt = next((j for j, q in enumerate(blocks) if j not in used and j not in chain and not label.match(q["text"]) and abs(q["fontsize"] - p["fontsize"]) <= 0.12 * p["fontsize"] and abs(q["hpos"] - p["hpos"]) <= p["fontsize"] and 0 <= q["vpos"] - p["vpos"] - p["height"] <= (0.8 if p["fontsize"] > 0.95 * body else 1.5) * p["fontsize"]), None)
                if nxt is None:
                    break
                chain.append(nxt)
            used.update(chain)
            out.append({"kind": "table" if m and m[1].lower().startswith("tab") else "figure", "label": m[0].strip() if m else None, "text": " ".join(blocks[j]["text"] for j in chain), "source": source, "blocks": [blocks[j]["block_no"] for j in chain]})
    return sorted(out, key=lambda c: c["blocks"][0])


class Repeats:
    """Tells which words repeat an earlier one on top of it: the same text, and at least half of the narrower and of the lower box in common.

    Kept boxes of a text are sorted by their left edges, so that a word is compared with those that begin within the widest one's reach."""

    def __init__(self):
        self.kept: dict[str, list[tuple[float, float, float, float]]] = defaultdict(list)
        self.widest: dict[str, float] = defaultdict(float)

    def repeats(self, text: str, x0: float, x1: float, top: float, bottom: float) -> bool:
        """Whether the word repeats a kept one; else it is kept."""
        kept = self.kept[text]
        i = bisect_left(kept, (x0 - self.widest[text],))
        while i < len(kept) and kept[i][0] <= x1:
            a0, a1, t, b = kept[i]
            if min(a1, x1) - max(a0, x0) >= 0.5 * min(a1 - a0, x1 - x0) and min(b, bottom) - max(t, top) >= 0.5 * min(b - t, bottom - top):
                return True
            i += 1
        insort(kept, (x0, x1, top, bottom))
        self.widest[text] = max(self.widest[text], x1 - x0)
        return False


def words_as_drawn(glyphs: list[dict]) -> list[list[dict]]:
    """Glyphs in the order of drawing as words: a blank, a gap of a quarter of the size, a step back or another line begins a new one."""
    out: list[list[dict]] = []
    last = None
    for g in glyphs:
        if not g["text"].strip():
            last = None
            continue
        size = max(g["size"], 1.0)
        if last is None or not -0.3 * size <= g["x0"] - last["x1"] <= 0.25 * size or abs(g["bottom"] - last["bottom"]) > 0.1 * size:
            out.append([])
        out[-1].append(g)
        last = g
    return out


def without_repeated_words(glyphs: list[dict]) -> list[dict]:
    """Glyphs (in the order of drawing) without the words that repeat an earlier one on top of it, as shadows do."""
    found, gone = Repeats(), set()
    for w in words_as_drawn(glyphs):
        box = min(g["x0"] for g in w), max(g["x1"] for g in w), min(g["top"] for g in w), max(g["bottom"] for g in w)
        if found.repeats("".join(g["text"] for g in w), *box):
            gone.update(map(id, w))
    return [g for g in glyphs if id(g) not in gone]


def by_page(rows: DataFrame, one: Callable[[list[dict]], Iterable[tuple]], columns: str, *order: str, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """What one(page) gives for the rows of each page (dicts in this order), behind the page's keys. The rows of a partition are sorted and read in batches, so that a
    small page costs what its rows cost, and no more than a page and a batch is held."""
    names = [c.split()[0] for c in columns.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, key, out = [], None, []
        for batch in batches:
            for values in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                row = dict(zip(batch.columns, values, strict=True))
                at = tuple(row[k] if row[k] == row[k] else None for k in keys)  # a missing key is no number
                if at != key and page:
                    out += [(*key, *x) for x in one(page)]
                    page = []
                key = at
                page.append(row)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if page:
            out += [(*key, *x) for x in one(page)]
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(read, columns)


def distinct_words(words: DataFrame) -> DataFrame:
    """words (doc_id, page, word_no, text, x0, x1, top, bottom) without those that repeat an earlier one (by word_no) on top of it."""
    keys = ("doc_id", "page")
    own = [c for c in words.columns if c not in keys]
    columns = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in (*keys, *own))

    def one(page: list[dict]) -> list[tuple]:
        found = Repeats()
        return [tuple(w[c] for c in own) for w in page if not found.repeats(w["text"], w["x0"], w["x1"], w["top"], w["bottom"])]

    return by_page(words, one, columns, "word_no").select(*words.columns)


LINES = "doc_id long, page int, line_no int, region int, text string, x0 double, x1 double, top double, bottom double, size double, bold boolean"


def page_lines(page: pd.DataFrame, page_w: float = 600.0, page_h: float = 800.0) -> pd.DataFrame:
    """line_rows() of a page's glyphs, with its number."""
    rows = line_rows(page.sort_values("si").to_dict("records"), page_w, page_h)
    return pd.DataFrame([(page.doc_id.iloc[0], page.page.iloc[0], *x) for x in rows], columns=[c.split()[0] for c in LINES.split(", ")])


def line_rows(rows: list[dict], page_w: float = 600.0, page_h: float = 800.0) -> list[tuple]:
    """Lines of a page in reading order, by the recursive cut; overprints dropped, vertical text last, regions by their column path. rows: glyphs as drawn."""
    rows = [g for g in rows if not any(pd.isna(g[c]) for c in ("x0", "x1", "top", "bottom")) and not (g["text"] or "").startswith("(cid:")]
    glyphs = without_repeated_words(without_overprints([g for g in rows if g["text"]]))
    turned = [g for g in glyphs if g.get("upright") is False]
    flat = [g for g in glyphs if g.get("upright") is not False]
    if len(flat) < 3 * len(turned):
        flat, turned = glyphs, []
    ink = [g for g in flat if g["text"].strip()]
    out = []
    if ink:
        sizes = [g["size"] for g in ink]
        tol = min(max(0.25 * statistics.median(sizes), 1.5), 3.0)
        paths: dict[tuple, int] = {}
        for leaf, path in arranged(cut(ink), page_w, page_h).leaves():
            region = paths.setdefault(path, len(paths))
            box = leaf.box
            blanks = [g for g in flat if not g["text"].strip() and box[0] <= g["x0"] <= box[2] and box[1] - 1 <= g["bottom"] <= box[3] + 1]
            for line in lines_of(leaf.glyphs, statistics.median(g["size"] for g in leaf.glyphs)):
                y = statistics.median(g["bottom"] for g in line)
                with_blanks = sorted([*line, *[b for b in blanks if abs(b["bottom"] - y) <= 0.5 * b["size"]]], key=lambda g: ((g["x0"] + g["x1"]) / 2, g["si"]))
                texts = logical([composed("".join(g["text"] for g in w)) for w in words_of(with_blanks, tol)])
                bold = sum(bool(re.search("bold|black|heavy", g.get("fontname") or "", re.I)) for g in line) * 2 > len(line)
                out.append((region, " ".join(texts), min(g["x0"] for g in line), max(g["x1"] for g in line), min(g["top"] for g in line), max(g["bottom"] for g in line), Counter(g["size"] for g in line).most_common(1)[0][0], bold))
    for w in rotated_words(turned, 3.0):
        out.append((-1, w, 0.0, 0.0, 0.0, 0.0, 0.0, False))
    return [(i, *x) for i, x in enumerate(out)]


def read_pages(glyphs: DataFrame) -> DataFrame:
    """Lines of all pages. glyphs: doc_id, page, si, text, x0, x1, top, bottom, size, fontname, upright; optional page_w, page_h."""
    return by_page(glyphs, lambda page: line_rows(page, first(page, "page_w", 600.0), first(page, "page_h", 800.0)), LINES, "si")


def first(page: list[dict], column: str, default: float) -> float:
    """A value that is the same in all rows of a page; the default where the page does not say."""
    value = page[0].get(column)
    return default if value is None or pd.isna(value) else float(value)


def ordered(blocks: DataFrame) -> DataFrame:
    """blocks (seq, x0, y0, x1, y1, line_h) with place, the order in which they are read."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)

    def one(page: pd.DataFrame) -> pd.DataFrame:
        rows = reading_order(page.to_dict("records"))
        return pd.DataFrame([r | {"place": i} for i, r in enumerate(rows)], columns=[*page.columns, "place"])

    return blocks.groupBy("doc_id", "page").applyInPandas(one, f"{columns}, place int")


def mask_rows(shapes: DataFrame, page_w: float = 600.0, page_h: float = 800.0, body: float = 10.0) -> DataFrame:
    """Masks of pages from shapes (kind image or other, x0, top, x1, bottom; optional page_w, page_h, body)."""

    def one(page: list[dict]) -> list[tuple]:
        boxes = {k: [(r["x0"], r["top"], r["x1"], r["bottom"]) for r in page if (r["kind"] == "image") == k] for k in (True, False)}
        got = masks(boxes[True], boxes[False], first(page, "page_w", page_w), first(page, "page_h", page_h), first(page, "body", body))
        return [(i, k, *b) for i, (k, b) in enumerate(got)]

    return by_page(shapes, one, "doc_id long, page int, region_id int, kind string, x0 double, top double, x1 double, bottom double", "kind", "top", "x0", "bottom", "x1")


def captions(blocks: DataFrame, beside: DataFrame, body: float) -> DataFrame:
    """Captions of pages from blocks (block_no, text, fontsize, hpos, vpos, height; optional body) and what regions they stand beside."""
    both = blocks.join(beside.select("doc_id", "page", "block_no", "side", "gap"), ["doc_id", "page", "block_no"], "left")

    def one(page: list[dict]) -> list[tuple]:
        near = {r["block_no"]: (r["side"], r["gap"]) for r in page if isinstance(r["side"], str)}
        got = grown_captions(page, near, first(page, "body", body))
        return [(i, c["kind"], c["label"], c["text"], c["source"], c["blocks"]) for i, c in enumerate(got)]

    return by_page(both, one, "doc_id long, page int, cap_no int, kind string, label string, text string, source string, blocks array<int>", "block_no")


def lane_rows(lines: DataFrame, page_w: float = 600.0) -> DataFrame:
    """Lane of each line (line_no, x0, x1, bottom, size) on pages whose stream jumps between columns."""

    def one(page: pd.DataFrame) -> pd.DataFrame:
        got = lanes(page.to_dict("records"), page_w)
        return pd.DataFrame([(page.doc_id.iloc[0], page.page.iloc[0], k, v) for k, v in sorted(got.items())], columns=["doc_id", "page", "line_no", "lane"])

    return lines.groupBy("doc_id", "page").applyInPandas(one, "doc_id long, page int, line_no int, lane int")

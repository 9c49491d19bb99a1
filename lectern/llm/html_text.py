"""HTML extraction (operator 2): flat text blocks, classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. Each has its word count and link density, those of
the blocks before and after it, and marks of the containers it stands in. A decision tree of Gini splits
is trained on a small labelled table: the blocks of the written example pages below, whose content blocks
are known. The blocks that it takes for content, in page order, are the text."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

#: Elements that end a block of text where they begin and end.
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noframes ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul video audio".split())
#: Elements whose content is not text.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas head title textarea select button audio video map noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers of page furniture, and of the main text.
FURNITURE = frozenset("nav header footer aside form menu dialog search fieldset".split())
MAIN = frozenset(("article", "main"))
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
FURNITURE_NAMES = re.compile(r"(?:^|[-_ ])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumb\w*|side-?bar\w*|footer|header|masthead|cookie\w*|consent|notice\w*|alert|popup|modal|subscribe|newsletter|share|sharing|social|related|recommend\w*|comment\w*|disqus\w*|repl(?:y|ies)|respond|widget\w*|pagination|pager|toolbar|login|signup|copyright|legal|disclaimer|skip\w*|toc|tags?|byline-links)(?:$|[-_ ])", re.I)
MAIN_NAMES = re.compile(r"(?:^|[-_ ])(?:article\w*|post-?(?:body|content|text)?|entry\w*|content\w*|main\w*|story\w*|body-?text|text-?body)(?:$|[-_ ])", re.I)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "main", "heading", "furniture_in_main")

#: Where a tag, a comment or a declaration begins; any other < is text.
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
_INSIDE = re.compile(r"[<>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


class Markup:
    """Reads the tags of a page forwards, each character a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self._gone: set[str] = set()  # what no longer comes

    def find(self, needle: str, at: int) -> int:
        found = -1 if needle in self._gone else self.page.find(needle, at)
        if found < 0:
            self._gone.add(needle)
        return found

    def after(self, needle: str, at: int) -> int:
        """The end of the next needle; the page's end if none comes."""
        found = self.find(needle, at)
        return found + len(needle) if found >= 0 else len(self.page)

    def tag(self, at: int) -> tuple[int, str, str, str, str]:
        """What begins with the < at `at`: its end, the text in it (of a marked section), / if it closes, name (empty for what is no element), attributes."""
        page = self.page
        if page.startswith("<!--", at):
            return self.after("-->", at + 4), "", "", "", ""
        if page.startswith("<![CDATA[", at) and (end := self.find("]]>", at)) >= 0:
            return end + 3, page[at + 9 : end], "", "", ""
        m = _NAME.match(page, at + 1)
        if m is None:
            return self.after(">", at), "", "", "", ""
        end, inner = self._tag_end(m.end())
        return end, "", m[1], m[2].lower(), page[m.end() : inner]

    def _tag_end(self, at: int) -> tuple[int, int]:
        """Where the tag ends whose attributes begin at `at`, and where these end.

        A quote counts after an equals sign. One that is not closed, or whose closing quote is followed by neither blank, slash nor > while there is a > before
        it, was forgotten: the tag ends at its first >. The next tag ends one that was left open."""
        page = self.page
        while m := _INSIDE.search(page, at):
            i = m.start()
            if m[0] == ">":
                return i + 1, i
            if m[0] == "<":
                if _OPEN.match(page, i):
                    return i, i
            elif page[at:i].rstrip().endswith("="):
                close = self.find(m[0], i + 1)
                odd = close >= 0 and page[close + 1 : close + 2].strip(" \t\n\r\f/>") and page.find(">", i, close) >= 0
                if close < 0 or odd:
                    end = self.after(">", i)
                    return end, end - 1
                at = close + 1
                continue
            at = i + 1
        return len(page), len(page)


class Cut:
    """The flat blocks of a page, in order: text, words, linked words, and marks of their containers."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.rows: list[tuple[int, float, int, int, int, int]] = []
        self._parts: list[str] = []
        self._linked = 0
        self._stops: dict[str, tuple[int, int]] = {}
        markup = Markup(page)
        stack: list[tuple[str, int, int, int]] = []  # name, furniture, main, furniture within main
        open_: Counter[str] = Counter()  # names on the stack
        link = at = heading = 0
        while m := _OPEN.search(page, at):
            self._take(page[at : m.start()], link)
            at, marked, closes, name, attributes = markup.tag(m.start())
            self._take(marked, link)
            if not name:
                continue
            if name in BLOCKS:
                self._flush(stack, heading)
                link = link if name == "br" else 0
                heading = int(len(name) == 2 and name[0] == "h" and name[1].isdigit() and not closes)
            if closes:
                if name == "a":
                    link = 0
                while open_[name]:
                    last = stack.pop()[0]
                    open_[last] -= 1
                    if last == name:
                        break
                continue
            if name in HIDDEN and not attributes.endswith("/"):
                at = self._hidden_end(page, name, at, stack[-1][0] if stack else "")
                continue
            if name == "a":
                link = 1
            if name in VOID or attributes.endswith("/"):
                continue
            if name == "p":  # a paragraph ends an open one
                while stack and stack[-1][0] == "p":
                    open_[stack.pop()[0]] -= 1
            up = stack[-1] if stack else ("", 0, 0, 0)
            bad, good = name in FURNITURE, name in MAIN
            if attributes and name not in ("html", "body"):
                for x in _ATTRIBUTE.finditer(attributes):
                    kind, value = x[1].lower(), x[2] or x[3] or x[4] or ""
                    if kind == "role":
                        bad, good = bad or value.lower() in FURNITURE_ROLES, good or value.lower() == "main"
                    elif kind in ("class", "id"):
                        bad, good = bad or bool(FURNITURE_NAMES.search(value)), good or bool(MAIN_NAMES.search(value))
                    elif kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "style" and re.search(r"display\s*:\s*none", value, re.I):
                        bad = True
            if name in BLOCKS or bad:
                good = good and not bad
                stack.append((name, up[1] or int(bad), up[2] or int(good), up[3] or int(bad and up[2])))
                open_[name] += 1
        self._take(page[at:], link)
        self._flush(stack, heading)

    def _hidden_end(self, page: str, name: str, at: int, parent: str) -> int:
        """Where the hidden element ends whose content begins at `at`.

        Scripts and styles end at their closing tag, or with the page. Others end there too, if it comes before another
        opening tag of the name, the body and the end of what they stand in; else they were left open, and only the text up to the next tag is theirs."""
        if name in ("script", "style"):
            stops = (f"</{name}",)
        else:
            stops = (f"</{name}", f"<{name}", "<body", *((f"</{parent}",) if parent else ()))
        first = min((self._next(page, stop, at), stop) for stop in stops)
        if first[1] == stops[0] and first[0] < len(page):
            end = page.find(">", first[0])
            return end + 1 if end >= 0 else len(page)
        return len(page) if len(stops) == 1 else max(at, min(page.find("<", at) % (len(page) + 1), len(page)))

    def _next(self, page: str, stop: str, at: int) -> int:
        """The place of the next tag that begins with stop, from `at` on; the page's length if there is none. Each stretch is searched once for each stop."""
        low, found = self._stops.get(stop, (0, -1))
        if found < at or low > at:
            m = re.compile(re.escape(stop) + r"(?=[\s/>])", re.I).search(page, at)
            low, found = at, m.start() if m else len(page)
            self._stops[stop] = low, found
        return found

    def _take(self, raw: str, link: int) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self._parts.append(text)
            if link:
                self._linked += len(text.split())

    def _flush(self, stack: list[tuple[str, int, int, int]], heading: int) -> None:
        if self._parts:
            words = "".join(self._parts).split()
            if words:
                top = stack[-1] if stack else ("", 0, 0, 0)
                self.texts.append(" ".join(words))
                self.rows.append((len(words), min(1.0, self._linked / len(words)), top[1], top[2], heading, top[3]))
            self._parts = []
        self._linked = 0

    def features(self) -> np.ndarray:
        """A row of FEATURES for each block; neighbours beyond the page's ends have no words."""
        x = np.array(self.rows, np.float64).reshape(-1, 6)
        wide = np.zeros((len(x) + 2, 2))
        wide[1:-1] = x[:, :2]
        return np.column_stack([x[:, :2], wide[:-2], wide[2:], x[:, 2:]])


class Tree:
    """A decision tree of Gini splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, deepest: int = 6, least: int = 2):
        self.at, self.cut, self.share = -1, 0.0, float(y.mean()) if len(y) else 0.0
        if deepest == 0 or len(y) < 2 * least or y.min() == y.max():
            return
        best = 1.0
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, c = x[order, j], np.cumsum(y[order])
            n = np.arange(1, len(v))
            ok = (v[1:] > v[:-1]) & (n >= least) & (len(v) - n >= least)
            left, right = c[:-1] / n, (c[-1] - c[:-1]) / (len(v) - n)
            gini = np.where(ok, (n * left * (1 - left) + (len(v) - n) * right * (1 - right)) / len(v), 1.0)
            i = int(np.argmin(gini))
            if gini[i] < best - 1e-12:
                best, self.at, self.cut = float(gini[i]), j, float(v[i] + v[i + 1]) / 2
        if self.at >= 0:
            low = x[:, self.at] <= self.cut
            self.low, self.high = Tree(x[low], y[low], deepest - 1, least), Tree(x[~low], y[~low], deepest - 1, least)

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.at < 0:
            return np.full(len(x), self.share)
        low = x[:, self.at] <= self.cut
        out = np.empty(len(x))
        out[low], out[~low] = self.low.of(x[low]), self.high.of(x[~low])
        return out


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The small labelled table: example pages in which each block of the main text begins with the word Yes."""
    long_ = "Yes the river rose in spring and the village moved its boats, its nets and its stores up to the old road by the hill, where they stayed until the water fell again."
    mid = "Yes the road is open again and the boats are back."
    linked = 'Yes it was written down in <a href="/b">the parish book</a> and read aloud on the green every year since.'
    ad = "Fresh boats at low prices, delivered to your door this week only, so order before the tide turns and save."
    menu = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "boats", "nets", "contact us")) + "</ul>"
    bodies = [
        f"<h1>Yes a river town</h1><p>{long_}</p><p>{mid}</p><p>{linked}</p><p>Yes.</p><p>{long_}</p>",
        f"<h1>Yes short</h1><p>Yes.</p><p>Yes so.</p><p>{mid}</p>",
        f"<h1>Yes list</h1><p>{long_}</p><ul><li>Yes one net</li><li>Yes two boats and a stove</li></ul><blockquote>{mid}</blockquote><p>{long_}</p>",
        f"<p>{long_}</p><h2>Yes after the flood</h2><p>{long_}</p><pre>Yes 12 30 44</pre><table><tr><td>Yes depth</td><td>Yes 4</td></tr></table>",
        f"<h1>Yes all quiet</h1><p><b>{mid}<br><p>{long_}</p>",
    ]
    tops = [f"<nav>{menu}</nav>", f"<header><h1>Net News</h1><p>{ad}</p>{menu}</header>", f'<div class="menu">{menu}</div><div class="cookie-notice">{ad}</div>', f'<div id="banner">Net News</div><nav>{menu}</nav><form><label>Search</label> words to look for</form>', '<div class="breadcrumbs"><a href="/">home</a> / <a href="/n">news</a></div>', f"<div>{menu}</div>", f"<div>Net News</div><div>{menu}</div>"]
    tails = [f"<footer>&copy; Net News. {ad}</footer>", f'<aside><h3>Read also</h3>{menu}</aside><footer><a href="/i">imprint</a></footer>', f'<div class="sidebar"><p>{ad}</p>{menu}</div>', f'<section class="comments"><h2>Comments</h2><p>{ad}</p><p>so true</p></section><footer>Net News</footer>', f'<div class="ad">{ad}</div><div role="contentinfo">Net News, all rights</div>', f"<div>{menu}</div><div>Net News 1999</div>", f"<table><tr><td>{menu}</td></tr></table>"]
    frames = ["<article>{}</article>", '<main><div class="x">{}</div></main>', '<div class="entry-content">{}</div>', "<div>{}</div>"]
    x, y = [], []
    for i, body in enumerate(bodies):
        for j, frame in enumerate(frames):
            for k in range(len(tops)):
                inner = body
                if k == 1:
                    inner += f'<div class="share"><a href="/s">share this</a> with friends</div><aside>{ad}</aside>'
                if k == 3:
                    inner = f'<div class="advert">{ad}</div>' + inner + f'<div class="comments"><p>{ad}</p></div>'
                c = Cut(f"<html><head><title>Yes</title></head><body>{tops[k]}{frame.format(inner)}{tails[(i + j + k) % len(tails)]}</body></html>")
                x.append(c.features())
                y += [t.startswith("Yes") for t in c.texts]
    return np.concatenate(x), np.array(y, np.float64)


@lru_cache
def tree() -> Tree:
    return Tree(*labelled())


def main_text(page: str | None) -> str:
    """The main text of a page; blocks are joined by an empty line."""
    if not page:
        return ""
    cut = Cut(page)
    if not cut.texts:
        return ""
    keep = tree().of(cut.features()) >= 0.5
    return "\n\n".join(t for t, ok in zip(cut.texts, keep.tolist(), strict=True) if ok)


def _task() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """A row for each row of pages: page_id, url, text, n_chars (code points).

    A null page counts as empty and has the empty text. A line break (br) ends a block, as a paragraph does. Blocks of which the tree's leaf
    has as many of one kind as of the other are kept. Character references are decoded, white space inside a block
    (Unicode's) becomes one blank. Repeated rows are repeated; other columns are ignored; an empty table gives an empty
    result. One narrow map, without a shuffle; memory holds a batch of pages."""
    return arrow_map(pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[page].alias("html")), _task, "page_id long, url string, text string, n_chars long")

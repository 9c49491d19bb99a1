"""Tags read forwards: damaged pages in linear time without markup in texts; blocks against a second parser."""

import html.parser
import time

import pyarrow.parquet as pq
import pytest

from lectern.llm import html_text

PAGES = "/root/testdata/sf0.01/pages.parquet"
FORMS = ["<a ", '<p title="', "<p title='", "<p class=\"x>words of it ", "<!--", "<![CDATA[", "<!", "</a ", "<div class=", "<svg><title>", "<a =\"'>", "<div>", "</", "<p a=b'c>"]


@pytest.mark.parametrize("form", FORMS)
def test_damaged_pages_in_linear_time(form):
    page = form * (1_000_000 // len(form))
    began = time.perf_counter()
    text = html_text.main_text("<article><p>A first paragraph, which is of some length and stands alone.</p>" + page)
    assert time.perf_counter() - began < 8  # the larger part of a second, where nothing else runs
    assert "<" not in text and "title=" not in text and "class=" not in text


def test_unclosed_and_closed_names():
    page = "<div>" * 50_000 + "</b></section>" * 50_000 + "</div>" * 50_000
    began = time.perf_counter()
    html_text.Cut(page)
    assert time.perf_counter() - began < 8


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ('<p>one</p><p class="x>next para words</p><p>last</p>', ["one", "next para words", "last"]),
        ('<p>one</p><p class="x>next <a href="y">linked</a> words</p>', ["one", "next linked words"]),
        ("<p title=\"a > b\">kept</p><p title='<b>'>too</p>", ["kept", "too"]),
        ("<p data-x=it's>a < b and c > d, it's <b>so</b>", ["a < b and c > d, it's so"]),
        ("<p <b>bold</b> rest", ["bold rest"]),
        ("before <![CDATA[a < b]]> after", ["before a < b after"]),
        ("text <a href='x", ["text"]),
        ("text <!-- never closed <p>more", ["text"]),
        ("x <3 y </ z> w", ["x <3 y w"]),
        ("<p>a<p>b</section></p>c", ["a", "b", "c"]),
        ("<script>if (a <b && c = \"</p>\") {}</script>seen", ["seen"]),
    ],
)
def test_blocks_of_damaged_pages(page, blocks):
    assert html_text.Cut(page).texts == blocks


class Second(html.parser.HTMLParser):
    """Flat blocks by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.hidden = [], [], []

    def cut(self):
        if words := "".join(self.parts).split():
            self.blocks.append(" ".join(words))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS and not self.hidden:
            self.cut()
        if tag in html_text.HIDDEN and (tag in ("script", "style") or not self.hidden):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        elif tag in html_text.BLOCKS and not self.hidden:
            self.cut()

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_blocks_equal_a_second_parser():
    pages = pq.read_table(PAGES)["html"].to_pylist()
    for page in pages:
        second = Second()
        second.feed(page or "")
        second.close()
        second.cut()
        assert html_text.Cut(page or "").texts == second.blocks

"""Pages by their tree: the tokenizer against the standard library's parser with a stack, the expressions against the tokenizer."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siftline.functions import html as H

DROPPED = {"script", "style", "noscript", "nav", "footer", "header"}
EMPTY = {"br", "img", "hr", "input", "link", "meta"}


class Plain(HTMLParser):
    """Text outside dropped elements, by a stack of open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.nodes, self.title, self.raw = [], [], None, False

    def handle_starttag(self, tag, attrs):
        if tag not in EMPTY:
            self.path.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.path:
            while self.path.pop() != tag:
                pass

    def handle_data(self, data):
        if not DROPPED.intersection(self.path):
            self.nodes.append(data)
            if self.path and self.path[-1] == "title" and self.title is None:
                self.title = data


def lines(text):
    return [x.strip() for x in text.splitlines() if x.strip()]


def plain(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    return (parser.title or "").strip(), lines("\n".join(parser.nodes))


PIECES = [
    "<div>", "</div>", "<DIV class=a>", "<p title=\"a > b\">", "<p title='<nav>'>", "</p>", "<nav>", "</nav>", "<nav class=\"x\">", "</NAV >", "<header>", "</header>",
    "<footer id=f>", "</footer>", "<noscript>", "</noscript>", "<script>if (a < b && c > d) { x = \"</p>\"; }</script>", "<style>p > b {}</style>", "<!-- <nav> -->", "<!-- x -->",
    "<br>", "<br/>", "<img src=\"a.png\" alt='1 > 0'>", "<nav-bar>", "</nav-bar>", "<nav/>", "<title> A &amp; B </title>", "one", " two ", "&lt;3&gt;", "&nbsp;", "5 &euro;", "\n", "a = b",
    "<ul><li>", "</li></ul>", "<b data-x = \"y\">", "</b>",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_tokenizer_follows_the_tree(pieces):
    page = "".join(pieces)
    title, text = H.parse_page(page)
    assert (title, lines(text)) == plain(page)


AWKWARD = [
    ('<p title="a > b">x</p>', ["x"]),
    ("<nav>a<nav>b</nav>c</nav>d", ["d"]),
    ("<div><nav>menu</div>text", ["text"]),
    ("<div><nav>menu</div>text</nav>more", ["text", "more"]),
    ("<nav>menu", []),
    ("<nav-bar>x</nav-bar><nav>m</nav>y", ["x", "y"]),
    ("<nav/>x", ["x"]),
    ("<script>a</script b>x<script>c</script>", ["x"]),
    ("<p <nav>x</p>y", ["x", "y"]),
    ("<?php echo 1 ?>x", ["x"]),
    ("x<!-- open", ["x"]),
    ('x<p title="open>y</p>', ["x"]),
    ("x < y <3", ["x < y <3"]),
    ("<footer>a<script>'</footer>'</script>b</footer>c", ["c"]),
    ("<header>a<!-- </header> -->b</header>c", ["c"]),
    ("<textarea><b>x</b></textarea>", ["<b>x</b>"]),
    ("</nav>x</p>", ["x"]),
    ("<title>a", ["a"]),
    ("<nav>" * 100_000 + "x", []),
    ("", []),
]


def found(spark, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "i long, h string").repartition(4)
    out = rows.select("i", H.needs_tree(F.col("h")).alias("tree"), H.page_title(F.col("h")).alias("title"), H.page_text(F.col("h")).alias("text"))
    return sorted(out.collect())


def test_awkward_pages(spark):
    rows = found(spark, [p for p, _ in AWKWARD] + [None])
    assert [r.text.split("\n") if r.text else [] for r in rows[:-1]] == [want for _, want in AWKWARD]
    assert rows[-1].title is None and rows[-1].text is None
    assert rows[0].tree and not rows[12].tree


def test_expressions_agree_with_the_tree(spark):
    rng = random.Random(5)
    pages = ["".join(rng.choices(PIECES, k=rng.randint(0, 7))) for _ in range(3000)]
    rows = found(spark, pages)
    assert 300 < sum(r.tree for r in rows) < 2900
    for row, page in zip(rows, pages):
        assert (row.title, row.text.split("\n") if row.text else []) == plain(page), page


@pytest.mark.parametrize("page", ["<p " * 200_000, '<p a="' * 200_000, "<nav>" * 200_000 + "x", "<div>" * 100_000 + "</p>" * 100_000 + "x", "<!--" * 200_000, "<a b=c " * 200_000])
def test_long_odd_pages_take_linear_time(page):
    title, text = H.parse_page(page)
    assert title == "" and lines(text) in ([], ["x"])

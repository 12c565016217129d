"""Reading tags: nested, broken and very large pages, with hand-written expectations."""

import time

import pytest

from shelfmark.functions import html as H
from shelfmark.operators import pages as G

BIG, TAG = 2 << 20, 10 << 20


@pytest.mark.parametrize(
    ("html", "left"),
    [
        ("<header><nav>n</nav>REST</header>kept", "kept"),
        ("a<nav>b<nav>c</nav>d</nav>e", "ae"),
        ("<div><nav>menu</div>after", "<div></div>after"),
        ("<nav>never closed", ""),
        ("x</nav>y", "x</nav>y"),
        ("<!-- <nav> -->a<!-- b -->c", "ac"),
        ("a<!-- never closed <b>c</b>", "a<!-- never closed <b>c</b>"),
        ("<script>if (a < b) '</nav>'</script>t<STYLE>p{}</STYLE >u", "tu"),
        ("<script>never closed <p>x", ""),
        ('<p style="a>b" class=c ONCLICK=\'x\' onload=f() data-on="1" on>t</p>', '<p class=c data-on="1">t</p>'),
        ("<p>1 < 2 > 0</p>", "<p>1 < 2 > 0</p>"),
        ('<noscript><img src="a"></noscript><br><footer>f<br></footer>z', "<br>z"),
        ("<iframe src=x>i</iframe>\n<a href='y'>", "\n<a href='y'>"),
        ("", ""),
    ],
)
def test_cleaned(html, left):
    assert H.cleaned_page(html) == left


def test_cleaned_in_spark(spark):
    rows = spark.createDataFrame([(1, "<nav>a</nav>" + "b" * 20_000), (2, None), (1, "<nav>a</nav>" + "b" * 20_000)], "page_id long, html string")
    found = [(r.page_id, r.html and len(r.html)) for r in G.html_clean(rows).collect()]
    assert sorted(found, key=str) == [(1, 15_000), (1, 15_000), (2, None)]


@pytest.mark.parametrize(
    ("html", "links"),
    [
        ("<a href='x>y' rel=next>t <b>u</b>\n v</a>", [("x>y", "t u v")]),
        ('<a href=1>a<a href="2">b</a>c', [("1", "a"), ("2", "b")]),
        ("<!-- <a href=no> --><script>'<a href=no>'</script><a href=yes>z", [("yes", "z")]),
        ("<a href='o'clock>x</a>", [("o", "x")]),
        ('<a title=it\'s href="q">x</a>', [("q", "x")]),
        ('<a href="never closed>x</a><b>', [("", "x")]),
        ("<a href=x", []),
        ("<a HREF=A href=b>t", [("A", "t")]),
        ("<abbr href=x>t</abbr><a\nhref\n=\n'n'\n>t</a>", [("n", "t")]),
    ],
)
def test_links_of_a_page(html, links):
    assert [(e.get("href"), e["text"]) for e in H.page_elements(html) if e["tag"] == "a"] == links


@pytest.mark.parametrize(
    "html",
    [
        "<a " + "x" * TAG + " href='/y'>t</a>", "<a " + "a='b' " * (BIG // 6) + "href='/y'>t</a>", "<a href='/y' c='" * (BIG // 20), "<a b='x \"" * (BIG // 20) + "'>",
        "<" * (BIG // 4), "<!--" * (BIG // 4), "<nav>" * (BIG // 20) + "</nav>" * (BIG // 20), "<a " + "= " * (BIG // 4) + ">", "<div>" * (BIG // 20) + "</p>" * (BIG // 20),
        "<a " + "x   " * (BIG // 8) + ">", "<script " * (BIG // 16), "<a>" * (BIG // 40),
    ],
)
def test_time_grows_with_the_page(html):
    start = time.process_time()
    H.cleaned_page(html)
    H.page_elements(html)
    assert time.process_time() - start < 4


def test_large_tags_in_spark(spark):
    """Tags of 2 kB, 200 kB and 10 MB, unclosed tags and quotes, through every job that reads tags."""
    rows = [(i, "https://a.com/l", "<a " + "x" * n + " href='/y'>t</a><meta property=og:title content='Red widget'><meta property='og:price:amount' content=9>") for i, n in enumerate((2_000, 200_000, TAG))]
    rows += [(3, "https://a.com/l", "<a href='/z'>Next</a><meta content='" + "y" * 5_000), (4, "https://a.com/l", "<a " + "b='c' " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(tuple(r) for r in G.link_extract(pages).collect()) == [(0, "https://a.com/y"), (1, "https://a.com/y"), (2, "https://a.com/y"), (3, "https://a.com/z")]
    assert sorted((r.page_id, r.title, r.price) for r in G.extract_cascade(pages).collect()) == [(i, "Red widget", 9.0) for i in range(3)]
    assert [tuple(r) for r in G.next_page(pages).collect()] == [(3, "https://a.com/z")]
    assert G.html_clean(pages).count() == 5


def test_repeated_pages_are_kept_once_each(spark):
    html = '<script type="application/ld+json">{"@type": "Product", "name": "Blue bolt", "offers": {"price": 3}}</script>'
    pages = spark.createDataFrame([(1, "https://a.com/x", html)] * 3, "page_id long, url string, html string")
    rules = spark.createDataFrame([("a.com", "title", "<h1>(.*)"), ("a.com", "title", "<h2>(.*)"), ("a.com", "price", "x(y)")], "domain string, field string, pattern string")
    for found in (G.extract_cascade(pages), G.extract_cascade(pages, rules)):
        assert [(r.page_id, r.via, r.title, r.price) for r in found.collect()] == [(1, "jsonld", "Blue bolt", 3.0)] * 3
    plan = G.extract_cascade(pages)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan

"""Page jobs on hand-written pages, clean and dirty ones."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import exprs as X
from shelfmark.operators import pages as G


def pages(spark, *rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "page_id long, url string, html string")


def jsonld(body):
    return f'<script type="application/ld+json">{body}</script>'


@pytest.mark.parametrize(
    ("text", "amount", "currency"),
    [("₹1,299", 1299, "INR"), ("$12.99", 12.99, "USD"), ("1,299.00 INR", 1299, "INR"), ("Rs. 499", 499, "INR"), ("USD 12.99", 12.99, "USD"), ("", None, "USD"), ("call us", None, "USD"), ("£5", 5, "GBP")],
)
def test_prices(spark, text, amount, currency):
    found = spark.range(1).select(X.price_normalize(F.lit(text)).alias("p")).first().p
    assert (found.amount, found.currency) == (amount, currency)


@pytest.mark.parametrize(
    ("text", "state"),
    [("https://schema.org/InStock", "in_stock"), ("Sold out", "out_of_stock"), ("Only 3", "limited_stock"), (None, "unknown"), (" ", "unknown"), ("OutOfStock", "out_of_stock"), ("soon", "unknown")],
)
def test_availability(spark, text, state):
    assert spark.range(1).select(X.availability_normalize(F.lit(text).cast("string")).alias("s")).first().s == state


@pytest.mark.parametrize(
    ("url", "found"),
    [("https://a.com/products/x", True), ("https://a.com/p/1", True), ("https://a.com/blog/product/x", False), ("https://a.com/product/x?id=3", False), ("https://a.com/about", False), (None, False)],
)
def test_product_urls(spark, url, found):
    assert spark.range(1).select(X.is_product_url(F.lit(url).cast("string")).alias("f")).first().f is found


def test_jsonld(spark):
    product = '{"@type": "Product", "name": "Blue bolt", "brand": "Acme", "offers": {"price": "$12.99", "availability": "InStock"}, "image": ["a.png", {"url": "b.png"}, "a.png"], "sku": 7}'
    rows = pages(
        spark,
        (None, jsonld(product)), (None, jsonld(f"[{product}]")), (None, jsonld('{"@graph": [{"@type": "Thing"}, %s]}' % product)),
        (None, jsonld("{broken") + jsonld(product)), (None, jsonld('{"@type": ["A", "product"], "name": "x", "offers": [{"price": 5, "priceCurrency": "EUR"}]}')),
        (None, jsonld('{"@type": "Organization"}')), (None, ""), (None, None), (None, jsonld("null")), (None, jsonld('{"@type": "Product", "offers": []}')),
    )
    found = {r.page_id: r for r in G.jsonld_fields(rows).collect()}
    for i in range(4):
        r = found[i]
        assert (r.title, r.price, r.currency, r.brand, r.availability, r.images, r.sku) == ("Blue bolt", 12.99, "USD", "Acme", "in_stock", ["a.png", "b.png"], "7")
    assert (found[4].price, found[4].currency) == (5.0, "EUR")
    assert all(found[i].title is None and found[i].price is None for i in range(5, 10))


def test_opengraph(spark):
    rows = pages(
        spark,
        (None, "<meta content='Tom &amp; co' property='og:title'><meta name=\"product:price:amount\" content=\"1,299.00\"><META property=og:image content=x.png>"),
        (None, '<meta property="og:title" content=""><meta name="og:title" content="By name"><meta property="og:price:amount" content="free">'), (None, None),
    )
    found = {r.page_id: r for r in G.opengraph_fields(rows).collect()}
    assert (found[0].title, found[0].price, found[0].currency, found[0].images) == ("Tom & co", 1299.0, "USD", ["x.png"])
    assert (found[1].title, found[1].price, found[1].currency) == ("By name", None, None)
    assert found[2].title is None


def test_cascade(spark):
    graph = '<meta property="og:title" content="{}"><meta property="og:price:amount" content="9">'
    rows = pages(
        spark,
        ("https://s.example.com/a", jsonld('{"@type": "Product", "name": "Welcome home", "offers": {"price": 3}}') + graph.format("Red widget")),
        ("https://s.example.com/b", "<h1>Green ring</h1><b>EUR 4.50</b>"), ("https://other.org/b", "<h1>Green ring</h1><b>EUR 4.50</b>"), ("https://s.example.com/c", graph.format("abcd")),
    )
    rules = spark.createDataFrame([("example.com", "title", "<h1>([^<]*)"), ("example.com", "price", "<b>([^<]*)")], "domain string, field string, pattern string")
    found = {r.page_id: (r.via, r.title, r.price, r.currency) for r in G.extract_cascade(rows, rules).collect()}
    assert found == {0: ("opengraph", "Red widget", 9.0, "USD"), 1: ("rules", "Green ring", 4.5, "EUR")}
    lacking = {(r.via, r.field): r.missing for r in G.missing_fields(G.extract_cascade(rows, rules, G.FIELDS)).collect()}
    assert lacking[("rules", "brand")] == 1 and ("rules", "price") not in lacking


@pytest.mark.parametrize(
    ("url", "html", "following"),
    [
        ("https://a.com/l?page=2", '<link href="/l?page=9" rel="next">', "https://a.com/l?page=9"),
        ("https://a.com/x/l", "<a href='more.html'><b>Next page</b></a>", "https://a.com/x/more.html"),
        ("https://a.com/l?q=1&page=2#top", "", "https://a.com/l?q=1&page=3#top"),
        ("https://a.com/l?page=99999999999999999999999", "", "https://a.com/l?page=100000000000000000000000"),
        ("https://a.com/l?page=" + "9" * 60, "", None),
        ("https://a.com/l/page/4", "", "https://a.com/l/page/5/"),
        ("https://a.com/l", '<a class="x current" href="/1">1</a><a href="/2">2</a>', "https://a.com/2"),
        ("https://a.com/l", '<a href="/1">1</a><a href="/2">2</a>', None),
        (None, None, None),
    ],
)
def test_next_page(spark, url, html, following):
    found = G.next_page(pages(spark, (url, html))).collect()
    assert [r.next for r in found] == ([following] if following else [])


def test_links(spark):
    html = """<a href="/products/a">x</a><a class=b href='rel/c'>y</a><a href=?q=1>z</a><a href="//a.com/d">w</a><a href="https://b.com/p/">v</a><a href="mailto:x@a.com">u</a><a href="#t">t</a><a>s</a>"""
    rows = pages(spark, ("https://www.a.com/f/g?h", html), (None, html), ("https://a.com", None))
    found = sorted(r.link for r in G.link_extract(rows).collect())
    assert found == sorted(["https://www.a.com/products/a", "https://www.a.com/f/rel/c", "https://www.a.com/f/g?q=1", "https://a.com/d"])
    assert [r.link for r in G.product_links(rows).collect()] == ["https://www.a.com/products/a"]

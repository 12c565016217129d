"""Sitemaps: indexes of indexes, cycles, and long elements."""

from shelfmark.sources import platforms as P


def test_any_depth_and_cycles(spark):
    url = lambda u, more="": f"<url {more}><loc> {u} </loc></url>"
    index = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc>https://a.com/{n}?x=1</loc></sitemap>" for n in names) + "</sitemapindex>"
    files = [
        ("i0.xml", index("i1.xml")), ("i1.xml", index("i2.xml", "i0.xml")), ("i2.xml", index("i3.xml", "i2.xml", "missing.xml")), ("i3.xml", index("u.xml", "t.txt", "i1.xml")),
        ("u.xml", "<urlset>" + url("https://a.com/products/1") + url("https://a.com/about") + url("https://a.com/products/2&amp;a", "x" * 300_000) + "<url></url></urlset>"),
        ("t.txt", "https://a.com/p/3\n\n https://a.com/p/4 \nhttps://a.com/blog/p/5"), ("lost.xml", "<urlset>" + url("https://a.com/products/9") + "</urlset>"), ("null.xml", None),
    ]
    rows = spark.createDataFrame(files, "file string, text string")
    found = sorted(r.url for r in P.sitemap_products(rows, ["i0.xml"]).collect())
    assert found == ["https://a.com/p/3", "https://a.com/p/4", "https://a.com/products/1", "https://a.com/products/2&a"]
    assert sorted(r.url for r in P.sitemap_products(rows).collect()) == sorted([*found, "https://a.com/products/9"])
    assert P.sitemap_products(rows, ["nothing.xml"]).collect() == []

"""Whole conflicts: labelled cases of the field rules, maps, lists, and rows of every kind."""

import datetime

import pytest

from shelfmark.operators import survive as S
from shelfmark.operators.normalize import norm_webhook_payload

SIDE = "canonicalProductId string, id string, source string, lastSyncedAt timestamp, title string, cleanedTitle string, brand string, normalizedBrand string, category string, description string, attributes map<string,string>, images array<string>, extra int"
DAY = lambda d: datetime.datetime(2026, 5, d, 10)


def side(spark, source, day, title=None, brand=None, attributes=None, images=None, key="c", n=1):
    row = (key, f"{source}-{day}", source, DAY(day) if day else None, title, None, brand, None, None, None, attributes, images, 1)
    return spark.createDataFrame([row] * n, SIDE)


@pytest.mark.parametrize(
    "old, new, winner, reason",
    [
        (("shopify", 1, "Shopify iPhone 13"), ("scraped", 2, "Scraped iPhone 13"), "existing", "source_priority"),
        (("shopify", 1, None), ("scraped", 2, "Scraped Title"), "incoming", "null_fallback"),
        (("shopify", 1, "Old Title"), ("shopify", 3, "New Title"), "incoming", "recency"),
        (("shopify", 3, "Short"), ("shopify", 3, "Much Longer Title"), "incoming", "completeness"),
        (("shopify", 3, "Same A"), ("shopify", 3, "Same B"), "existing", "completeness"),
        (("scraped", 3, "  "), ("scraped", 3, ""), "incoming", "null_fallback"),
        (("other", None, "a"), ("unknown", 3, "b"), "incoming", "recency"),
        (("other", 3, "a"), (None, None, "b"), "existing", "recency"),
        (("scraped", 3, "a"), ("SHOPIFY", 1, " "), "existing", "null_fallback"),
    ],
)
def test_fields(spark, old, new, winner, reason):
    row = S.resolve_whole(side(spark, *old), side(spark, *new)).first()
    assert [(c.field, c.winner, c.reason) for c in row.conflicts] == [("title", winner, reason)]
    assert row.title == (new if winner == "incoming" else old)[2]


def test_attributes_and_images(spark):
    old = side(spark, "magento", 1, "T", "Acme", {"color": "red", "size": "", "kept": "k"}, ["u1", " u2 ", None, ""])
    new = side(spark, "woocommerce", 2, "T", "BrandX", {"color": "blue", "size": "M", "new": "n", "none": None}, ["u2", "u3", "u3"])
    row = S.resolve_whole(old, new).first()
    assert row.attributes == {"color": "red", "size": "M", "kept": "k", "new": "n", "none": None} and row.images == ["u1", "u2", "u3"]
    told = {c.field: (c.existing, c.incoming, c.winner, c.reason) for c in row.conflicts}
    assert told == {
        "brand": ("Acme", "BrandX", "existing", "source_priority"), "attributes.color": ("red", "blue", "existing", "source_priority"),
        "attributes.size": ("", "M", "incoming", "null_fallback"), "attributes.new": (None, "n", "incoming", "null_fallback"),
    }


def test_rows_of_every_kind(spark):
    none = side(spark, "shopify", 1, key=None)
    old, new = side(spark, "shopify", 1), side(spark, None, None, "x" * 100000, n=3)
    found = S.resolve_whole(old.union(none), new.union(none)).collect()
    assert len(found) == 3 and all(len(r.title) == 100000 and r.attributes == {} and r.images == [] for r in found)
    assert S.resolve_whole(old.limit(0), new).count() == 0 and S.resolve_whole(old, new.limit(0)).count() == 0


@pytest.mark.parametrize(
    "payload, id, tags, quantity, currency",
    [
        ('{"id": 5, "tags": "a, ,b", "variants": [{"id": 1, "inventory_quantity": 3, "presentment_prices": [{"price": {"currency_code": "USD"}}]}]}', "gid://shopify/Product/5", ["a", "b"], 3, "USD"),
        ('{"id": "gid://shopify/Product/7", "tags": ["x, y"], "variants": [{"inventory_quantity": "many"}]}', "gid://shopify/Product/7", ["x, y"], None, "INR"),
        ('{"variants": [], "images": null, "tags": ""}', None, [], None, "INR"),
        ("[1]", None, [], None, "INR"), ("{broken", None, [], None, "INR"), ("", None, [], None, "INR"), (None, None, [], None, "INR"),
    ],
)
def test_webhook_payloads(spark, payload, id, tags, quantity, currency):
    row = norm_webhook_payload(spark.createDataFrame([(payload, "keep")], "payload string, p string").withColumnRenamed("p", "other")).first()
    assert (row.id, row.tags, row.currencyCode, row.other) == (id, tags, currency, "keep")
    assert [v.inventoryQuantity for v in row.variants][:1] == ([quantity] if payload and '"variants": [{' in payload else [])

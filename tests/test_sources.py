"""Scans of landed platform files."""

import json

from pyspark.sql import functions as F

from shelfmark.operators import normalize as N
from shelfmark.sources import platforms as P


def landed(tmp_path, name, data):
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps(data))
    return str(path)


def test_shopify(spark, tmp_path):
    node = {
        "id": "g1", "title": "<b>Tea</b>™  Pot", "vendor": " Acme ", "productType": "Kitchen", "status": "ACTIVE", "tags": ["a"],
        "priceRangeV2": {"minVariantPrice": {"amount": "5", "currencyCode": "EUR"}},
        "variants": {"edges": [{"node": {"id": "v1", "sku": " S1 ", "price": "5.50", "compareAtPrice": "7", "inventoryQuantity": 3}}, {"node": None}]},
        "media": {"edges": [{"node": {"preview": {"image": {"url": " "}}}}, {"node": {"preview": {"image": {"url": "http://x/1.jpg"}}}}]},
    }
    path = landed(tmp_path, "shopify", {"data": {"products": {"edges": [{"node": node}, {"node": None}]}}})
    rows = N.norm_shopify_products(P.scan_shopify(spark, path), "s").collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.title, row.cleanedTitle, row.brand, row.normalizedBrand, row.status, row.sku) == ("<b>Tea</b>™  Pot", "Tea Pot", "Acme", "acme", "active", "S1")
    assert [(v.variantId, v.price, v.compareAtPrice, v.currency, v.isInStock) for v in row.variants] == [("v1", 5.5, 7.0, "EUR", True)]
    assert [(i.url, i.position) for i in row.images] == [("http://x/1.jpg", 1)]


def test_magento(spark, tmp_path):
    item = {
        "id": 7, "sku": "M", "name": "Pan", "price": 9.5, "status": 2, "custom_attributes": [{"attribute_code": "brand", "value": "B"}, {"attribute_code": "color", "value": "red"}, {"attribute_code": "x", "value": " "}],
        "extension_attributes": {"stock_item": {"qty": 4, "is_in_stock": True}}, "media_gallery_entries": [{"label": "l", "position": 1, "disabled": True, "file": "/a.jpg"}, {"position": 2, "file": "/b.jpg"}],
    }
    path = landed(tmp_path, "magento", {"products": {"items": [item, None]}})
    row = N.norm_magento_products(P.scan_magento(spark, path), "s", "http://h/").first()
    assert (row.status, row.brand, row.attributes, row.images[0].url) == ("inactive", "B", {"color": "red"}, "http://h/pub/media/catalog/product/b.jpg")


def test_woocommerce_and_bigcommerce(spark, tmp_path):
    woo = landed(tmp_path, "woo", {"products": [{"id": 1, "name": "A", "price": "x", "stock_status": "instock", "status": "trash", "attributes": [{"name": "Brand", "slug": "pa_brand", "options": ["Q"]}]}]})
    row = N.norm_woo_products(P.scan_woocommerce(spark, woo), "s").first()
    assert (row.brand, row.status, row.variants[0].price, row.variants[0].variantId) == ("Q", "archived", 0.0, "1")
    big = landed(tmp_path, "big", {"productsAPI": {"data": [{"id": 2, "name": "B", "brand_id": 5, "price": 3.0, "is_visible": True}]}, "brandsAPI": {"data": [{"id": 5, "name": "Five"}]}})
    row = N.norm_bigcommerce_products(P.scan_bigcommerce(spark, big), "s").first()
    assert (row.brand, row.status, row.variants[0].price) == ("Five", "active", 3.0)


def test_inventory_and_since(spark, tmp_path):
    path = landed(tmp_path, "uni", {"inventoryAPI": {"inventorySnapshots": [{"itemTypeSKU": "S", "inventory": 12, "blockedInventory": 5}, {"itemTypeSKU": "T", "inventory": 1, "blockedInventory": 5}]}})
    rows = {r.sku: (r.availableInventory, r.availability) for r in N.norm_inventory(P.scan_unicommerce(spark, path), "s").collect()}
    assert rows == {"S": (7.0, "limited"), "T": (0.0, "out_of_stock")}
    times = spark.createDataFrame([("2024-01-02", None), (None, "2024-03-01"), (None, None)], "a string, b string")
    assert P.scan_incremental(times, [F.col("a"), F.col("b")], "2024-02-01").count() == 1
    assert P.scan_incremental(times, [F.col("a")], None).count() == 3


def test_sitemap(spark, tmp_path):
    (tmp_path / "map.xml").write_text("<urlset><url><loc> http://a/products/1 </loc></url><url><loc>http://a/products/1</loc></url><url><loc>http://a/2</loc></url></urlset>")
    assert sorted(r.url for r in P.scan_sitemap(spark, str(tmp_path / "map.xml")).collect()) == ["http://a/2", "http://a/products/1"]

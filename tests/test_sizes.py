"""Work is dealt over tasks by the number of rows, whatever the files that hold them."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import normalize as N
from shelfmark.operators import offers as O
from shelfmark.operators import serve as V
from shelfmark.operators import upsert as U
from shelfmark.plans import payloads, views
from shelfmark.sources import platforms as P

PARTS, LINES = 200, 900


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    """Tables of which each is one small file."""
    folder = str(tmp_path_factory.mktemp("packed"))
    k = F.col("id")
    text = lambda name, n: F.concat(F.lit(name), (k % n).cast("string"))
    parts = spark.range(PARTS).select(
        k.alias("p_partkey"), text("ring ", 7).alias("p_name"), text("Brand#", 3).alias("p_brand"), text("TYPE", 2).alias("p_type"),
        (k % 5).cast("int").alias("p_size"), (900 + k).cast("double").alias("p_retailprice"),
    )
    lines = spark.range(LINES).select(
        (k % PARTS).alias("l_partkey"), (k % 9).alias("l_suppkey"), (k % 40).cast("double").alias("l_extendedprice"), (k % 6).cast("double").alias("l_quantity"),
        F.lit("1996-01-01").cast("timestamp").alias("l_shipdate"),
    )
    for name, rows in (("part", parts), ("lineitem", lines)):
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def dealt(rows):
    """How many tasks hold rows."""
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def test_products_are_dealt_by_rows(spark, packed, monkeypatch):
    whole = sorted(map(str, views.products(spark, packed).collect()))
    monkeypatch.setattr(views, "PRODUCT_ROWS", 10)
    rows = views.products(spark, packed)
    assert dealt(rows) > 10
    assert sorted(map(str, rows.collect())) == whole and len(whole) == PARTS


@pytest.mark.parametrize("platform", ["shopify", "magento", "woocommerce", "bigcommerce", "unicommerce"])
def test_payloads_of_one_platform(spark, packed, platform):
    whole = payloads.bronze(spark, packed).where(F.col("platform") == platform)
    own = payloads.bronze(spark, packed, platform)
    assert sorted(own.collect()) == sorted(whole.collect()) and own.count() == PARTS


def test_payloads_are_parsed_once(spark, packed):
    archive = payloads.bronze(spark, packed, "shopify").repartition(2)
    plan = P.scan_raw_replay(archive, "shopify", P.SHOPIFY_NODE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_offers_are_dealt_by_rows(spark, packed, monkeypatch):
    whole = sorted(map(str, views.offers(spark, packed).collect()))
    monkeypatch.setattr(views, "LINE_ROWS", 30)
    rows = views.offers(spark, packed)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert views.offer_parts(spark, packed) == 30 and "hashpartitioning(l_partkey" in plan and ", 30)" in plan
    assert sorted(map(str, rows.collect())) == whole and whole


def test_modal_currency_without_windows(spark):
    """Of equals the currency whose last offer comes first; no sort of all offers."""
    rows = [("p", c, price, f"o{i}") for i, (c, price) in enumerate([("usd", 1.0), ("EUR", 2.0), ("EUR", 3.0), ("USD", 4.0), ("INR", 0.5)])]
    rows += [("q", "EUR", 2.0, "b"), ("q", "USD", 2.0, "a"), ("r", None, 1.0, "a"), (None, "USD", 1.0, "z"), ("s", "USD", None, "y")]
    found = O.modal_currency(spark.createDataFrame(rows, "canonicalProductId string, currency string, price double, id string"))
    assert {tuple(r) for r in found.collect()} == {("p", "EUR"), ("q", "USD"), ("r", None)}
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_only_cheapest_offers_meet_stores(spark, packed):
    offers = views.offers(spark, packed)
    canonical = spark.sql("select 'x' as canonicalId, 1.0D as priceMin, 'USD' as currency")
    stores = spark.sql("select 'store_1' as id, 'One' as name")
    plan = V.ai_price_context(canonical, offers, stores)._jdf.queryExecution().optimizedPlan().toString()
    first = lambda *words: next(i for i, line in enumerate(plan.splitlines()) if all(w in line for w in words))
    assert first("Join", "storeId") < first("Aggregate")  # stores meet what is left of the offers
    rows = offers.limit(1).withColumns({"canonicalProductId": F.lit("x"), "storeId": F.lit("store_1"), "isInStock": F.lit(True), "price": F.lit(2.0), "currency": F.lit("EUR")})
    assert V.ai_price_context(canonical, rows, stores).collect() == [("x", "Cheapest at One for 2.00 EUR")]


def test_parts_change_no_matches(spark):
    offers = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "1"), (None, "1")], "sku string, storeId string")
    variants = spark.createDataFrame([("p", "1", "a"), ("p", "1", "a"), ("q", "2", "c")], "productId string, storeId string, sku string")
    patches = spark.createDataFrame([(1, "a", "1"), (2, "a", None), (3, "c", None), (4, "d", "1"), (5, None, "1")], "seq int, sku string, storeId string")
    for parts in (1, 7):
        found = N.inventory_matches(patches, offers, variants, parts)
        assert {tuple(r)[0]: tuple(r)[3:] for r in found.collect()} == {1: (2, 1), 2: (3, 1), 3: (0, 1), 4: (0, 0), 5: (0, 0)}


def test_parts_change_no_archive(spark):
    old = spark.createDataFrame([("m", "1", "old"), ("m", "9", "kept")], "platform string, sourceId string, payload string")
    new = spark.createDataFrame([("m", '{"id": 1, "v": 1}'), ("m", '{"id": 1, "v": 2}'), ("m", "{}")], "platform string, payload string")
    for parts in (1, 7):
        found = U.raw_archive(old, new, parts=parts)
        assert {tuple(r) for r in found.collect()} == {("m", "9", "kept"), ("m", "1", '{"id": 1, "v": 2}'), ("m", None, "{}")}

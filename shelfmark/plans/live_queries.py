"""Queries over tables that a stream of product, inventory and delete events changes through a commit log, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import offers as O
from shelfmark.operators.survive import canonical_merge
from shelfmark.plans import views
from shelfmark.plans.views_sql import canonical_id, sql
from shelfmark.sources.shared import shared_folder
from shelfmark.streaming import handlers as H
from shelfmark.streaming.commits import CommitLog
from shelfmark.streaming.queries import webhook_stream

QUERIES, SQL = {}, {}
VARIANTS = "array<struct<variantId: string, sku: string, price: double, currency: string, inventoryQty: long, isInStock: boolean>>"


def query(text: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, text
        return f

    return add


def initial(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The tables before the first event: products with a variant and an offer each."""
    one = F.struct(
        F.concat("sourceId", F.lit("-0")).alias("variantId"), F.concat(F.lit("S"), "sourceId").alias("sku"), "price", "currency",
        F.lit(1).cast("long").alias("inventoryQty"), F.lit(True).alias("isInStock"),
    )
    products = views.products(spark, sf).withColumn("variants", F.array(one).cast(VARIANTS))
    offers = products.select(
        F.concat(F.lit("offer_"), "sourceId").alias("id"), F.col("id").alias("productId"), "sourceId", "storeId", F.concat("sourceId", F.lit("-0")).alias("variantId"),
        F.concat(F.lit("S"), "sourceId").alias("sku"), "price", "currency", F.lit(1).cast("long").alias("stockQty"), F.lit(True).alias("isInStock"),
        F.lit("in_stock").alias("availability"), "canonicalProductId", "lastSyncedAt",
    )
    return {
        "products": products, "offers": offers, "canonical": O.price_range_sync(canonical_merge(products), offers),
        "raw": spark.createDataFrame([], "sourceId string, storeId string, payload string, ts timestamp"),
        "rejected": spark.createDataFrame([], "event_id long, sourceId string, storeId string, errors array<string>, ts timestamp"),
    }


def keyed(events: DataFrame) -> DataFrame:
    """Events of the stream with the source id and store of their user; every seventh user is of no product."""
    user = F.col("user_id").cast("string")
    source_id = F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("n"), user)).otherwise(user)
    return events.withColumns({"sourceId": source_id, "storeId": F.concat(F.lit("store_"), (F.col("user_id") % 10).cast("string"))})


def product_payloads(events: DataFrame) -> DataFrame:
    """Create and update events with a product each; a fifth lacks a title, a third a brand."""
    none = F.lit(None).cast("string")
    title = F.when(F.floor("value") % 5 == 0, "").otherwise(F.concat(F.lit("Lamp "), (F.col("user_id") % 40).cast("string"), F.lit(" dual")))
    one = F.struct(
        F.concat("sourceId", F.lit("-"), (F.col("event_id") % 2).cast("string")).alias("variantId"), F.concat(F.lit("S"), "sourceId").alias("sku"), F.col("value").alias("price"),
        F.lit("INR").alias("currency"), F.floor(F.col("value") % 3).cast("long").alias("inventoryQty"), F.lit(True).alias("isInStock"),
    )
    rows = keyed(events).where(F.col("topic").isin("create", "update"))
    return rows.select(
        F.lit("shopify").alias("source"), "sourceId", "storeId", none.alias("sku"), title.alias("title"), F.when(F.col("event_id") % 3 != 0, "Live").alias("brand"),
        none.alias("category"), none.alias("description"), F.lit("INR").alias("currency"), F.col("value").alias("price"), F.array().cast("array<string>").alias("images"),
        F.create_map(F.lit("size"), F.lit("1")).alias("attributes"), F.array(one).cast(VARIANTS).alias("variants"), F.to_json(F.struct("event_id", "value")).alias("payload"), "ts", "event_id",
    )


def live(spark: SparkSession, sf: str, *steps) -> CommitLog:
    """The log after each step (events to payloads, handler) has taken the stream."""
    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    log = CommitLog(spark, folder, H.KEYS)
    log.begin(initial(spark, sf))

    def change(tx, batch: DataFrame) -> None:
        for events, handle in steps:
            handle(tx, events(batch))

    H.run(webhook_stream(spark, sf), log, change, f"{folder}/checkpoint")
    return log


OF_USER = "CASE WHEN user_id % 7 = 0 THEN 'n' ELSE '' END || user_id AS \"sourceId\", 'store_' || (user_id % 10) AS \"storeId\""
LIVE = {
    "events_live": f"""SELECT {OF_USER}, CASE WHEN floor(value) % 5 = 0 THEN '' ELSE 'Lamp ' || (user_id % 40) || ' dual' END AS title,
        CASE WHEN event_id % 3 <> 0 THEN 'Live' END AS brand, value AS price, ts, event_id FROM v_webhooks WHERE topic IN ('create', 'update')""",
    "last_live": """SELECT "sourceId", "storeId", arg_max(title, ROW(ts, event_id)) AS title, arg_max(brand, ROW(ts, event_id)) FILTER (brand IS NOT NULL) AS brand,
        arg_max(price, ROW(ts, event_id)) AS price FROM events_live WHERE title <> '' GROUP BY ALL""",
    "products_now": """SELECT "sourceId", "storeId", coalesce(l.title, p.title) AS title, coalesce(l.brand, p.brand) AS brand, coalesce(l.price, p.price) AS price,
        l.title IS NOT NULL AS changed FROM v_products p FULL JOIN last_live l USING ("sourceId", "storeId")""",
    "offers_live": """SELECT "sourceId", "storeId", "sourceId" || '-' || (event_id % 2) AS "variantId", arg_max(price, ROW(ts, event_id)) AS price
        FROM events_live WHERE title <> '' GROUP BY ALL""",
    "offers_now": """SELECT * FROM offers_live UNION ALL SELECT "sourceId", "storeId", "sourceId" || '-0', price FROM v_products p
        WHERE NOT EXISTS (FROM offers_live l WHERE l."sourceId" = p."sourceId" AND l."storeId" = p."storeId" AND l."variantId" = p."sourceId" || '-0')""",
}


@query(sql('SELECT "sourceId", "storeId", title, brand, price, changed FROM products_now', **LIVE))
def stream_catalog_products(spark, sf):
    """Products after all product events: fields that an event leaves blank stay, events without a title change nothing."""
    now = live(spark, sf, (product_payloads, H.product_events)).read("products")
    return now.select("sourceId", "storeId", "title", "brand", "price", F.coalesce(F.col("title").startswith("Lamp "), F.lit(False)).alias("changed"))


@query(sql('SELECT * FROM offers_now', **LIVE))
def stream_catalog_offers(spark, sf):
    return live(spark, sf, (product_payloads, H.product_events)).read("offers").select("sourceId", "storeId", "variantId", "price")


@query(sql(f"""SELECT c AS "canonicalId", count(DISTINCT ROW("sourceId", "storeId")) AS "productCount", min(o.price) AS "priceMin", max(o.price) AS "priceMax"
    FROM (SELECT *, {canonical_id("title", "brand")} AS c FROM products_now) JOIN offers_now o USING ("sourceId", "storeId") WHERE c IS NOT NULL GROUP BY c""", **LIVE))
def stream_catalog_canonical(spark, sf):
    """Canonical rows that have products after all product events."""
    log = live(spark, sf, (product_payloads, H.product_events))
    used = log.read("products").select(F.col("canonicalProductId").alias("canonicalId")).where("canonicalId is not null").distinct()
    return log.read("canonical").join(used, "canonicalId", "left_semi").select("canonicalId", "productCount", "priceMin", "priceMax")


@query(sql("""SELECT event_id, "sourceId", "storeId" FROM events_live WHERE title = ''""", **LIVE))
def stream_catalog_rejected(spark, sf):
    return live(spark, sf, (product_payloads, H.product_events)).read("rejected").select("event_id", "sourceId", "storeId")


def stock_changes(events: DataFrame) -> DataFrame:
    rows = keyed(events).where("topic = 'inventory'")
    quantity = F.when(F.col("value") < 100, F.floor(F.col("value") % 3).cast("long"))
    return rows.select("storeId", F.concat(F.lit("S"), "sourceId").alias("sku"), quantity.alias("quantity"), "ts", "event_id")


def deletions(events: DataFrame) -> DataFrame:
    sources = F.element_at(F.array(*map(F.lit, views.SOURCES)), (F.col("user_id") % 6 + 1).cast("int"))
    return keyed(events).where("topic = 'delete' and user_id % 4 = 1").select(sources.alias("source"), "sourceId", "storeId", "ts", "event_id")


STOCK = {
    "stock": """SELECT 'S' || CASE WHEN user_id % 7 = 0 THEN 'n' ELSE '' END || user_id AS sku, 'store_' || (user_id % 10) AS "storeId",
        arg_max(ROW(CASE WHEN value < 100 THEN CAST(floor(value % 3) AS BIGINT) END), ROW(ts, event_id)) AS q FROM v_webhooks WHERE topic = 'inventory' GROUP BY ALL""",
    "gone": f"SELECT DISTINCT {OF_USER} FROM v_webhooks WHERE topic = 'delete' AND user_id % 4 = 1",
    "stocked": """SELECT p."sourceId", p."storeId", s.sku IS NOT NULL AS hit, struct_extract(s.q, 1) AS q, g."sourceId" IS NOT NULL AS gone, p.status
        FROM v_products p LEFT JOIN stock s ON s.sku = 'S' || p."sourceId" AND s."storeId" = p."storeId" LEFT JOIN gone g ON g."sourceId" = p."sourceId" AND g."storeId" = p."storeId" """,
}


@query(sql("""SELECT "sourceId", CASE WHEN hit THEN q ELSE 1 END AS "stockQty", CASE WHEN gone THEN false WHEN hit THEN coalesce(q > 0, true) ELSE true END AS "isInStock",
    CASE WHEN gone OR (hit AND q = 0) THEN 'out_of_stock' ELSE 'in_stock' END AS availability FROM stocked""", **STOCK))
def stream_catalog_stock(spark, sf):
    """Offers after inventory and then delete events; no quantity is in stock, offers of deleted products are not."""
    log = live(spark, sf, (stock_changes, H.inventory_events), (deletions, H.delete_events))
    return log.read("offers").select("sourceId", "stockQty", "isInStock", "availability")


@query(sql("""SELECT "sourceId", CASE WHEN gone THEN 'inactive' ELSE status END AS status, CASE WHEN hit THEN q ELSE 1 END AS quantity,
    CASE WHEN hit THEN coalesce(q > 0, true) ELSE true END AS "isInStock" FROM stocked""", **STOCK))
def stream_catalog_variants(spark, sf):
    """Products and their variants after the same events."""
    log = live(spark, sf, (stock_changes, H.inventory_events), (deletions, H.delete_events))
    v = F.element_at("variants", 1)
    return log.read("products").select("sourceId", "status", v["inventoryQty"].alias("quantity"), v["isInStock"].alias("isInStock"))


KEPT_HOURS = 12


@query(sql(f"""SELECT user_id, arg_max("webhookId", event_id) AS "webhookId", arg_max(topic, event_id) AS topic, arg_max(ts, event_id) AS ts, max(event_id) AS event_id
    FROM v_webhooks GROUP BY user_id HAVING max(event_id) > (SELECT max(event_id) FROM events) - {KEPT_HOURS} * 60"""))
def stream_latest_arrival(spark, sf):
    """The last arrival of each user, of events that come a minute apart in the order of their ids; kept for 12 hours."""
    events = webhook_stream(spark, sf).withColumn("received", F.timestamp_seconds(F.col("event_id") * 60))
    folder = f"{shared_folder(spark)}/latest-{uuid.uuid4().hex}"
    log = CommitLog(spark, folder, {"latest": "user_id"})
    log.begin({"latest": spark.createDataFrame([], events.schema)})
    H.run(events, log, H.latest_arrivals("latest", "user_id", KEPT_HOURS), f"{folder}/checkpoint")
    held = log.read("latest")
    return H.fresh(held, held.agg(F.max("received")).first()[0], KEPT_HOURS).select("user_id", "webhookId", "topic", "ts", "event_id")

"""What product, inventory and delete events do to the tables of a commit log.

Tables: raw (sourceId, storeId, payload, ts), products, offers (by sourceId), canonical (by canonicalId), rejected (events
that break a rule). Events carry ts and event_id, which give their order; several of a key in a batch act as if they came
one after the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import exprs as X
from shelfmark.operators import offers as O
from shelfmark.operators.quality import validate_products
from shelfmark.operators.survive import canonical_merge
from shelfmark.operators.upsert import upsert_replace
from shelfmark.streaming.commits import CommitLog, Transaction

KEYS = {"raw": "sourceId", "products": "sourceId", "offers": "sourceId", "canonical": "canonicalId", "rejected": "sourceId"}
KEY = ["sourceId", "storeId"]
FILLED = ["sku", "title", "brand", "category", "description", "currency"]


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last event of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct("ts", "event_id")).alias("e")).select("e.*")


def _replaced(keys: list[str]):
    """Rows of the batch in place of those with the same keys."""
    return lambda now, new: now.join(new.select(*keys), keys, "left_anti").unionByName(new.select(now.columns))


def product_events(tx: Transaction, events: DataFrame) -> None:
    """Create and update events: archive, validate, match, canonical id, product, offers, canonical row, price range.

    ``events``: source, sourceId, storeId, FILLED, price, images, attributes, variants (array of variantId, sku, price,
    currency, inventoryQty, isInStock), payload, ts, event_id. What breaks a rule is archived and rejected, no more. A
    field that an event leaves blank stays as it was. A product is the one with its sourceId and storeId, else it takes the
    id of one in the store with its SKU, else a new one.
    """
    tx.change("raw", _last(events, KEY).select(*KEY, "payload", "ts"), _replaced(KEY))
    own = F.concat(F.lit("prod_"), F.substring(F.sha2(F.concat_ws("|", "storeId", "sourceId"), 256), 1, 16))
    checked = validate_products(events.withColumns({"id": own, "status": F.lit("active"), "lastSyncedAt": F.col("ts")}))
    tx.change("rejected", checked.where(F.size("errors") > 0).select("event_id", *KEY, "errors", "ts"), _replaced(["event_id"]))
    valid = checked.where(F.size("errors") == 0)
    order = F.struct("ts", "event_id")
    filled = [F.max_by(X.blank_to_null(F.col(c)), F.when(X.blank_to_null(F.col(c)).isNotNull(), order)).alias(c) for c in FILLED]
    whole = [F.max_by(c, order).alias(c) for c in ("source", "id", "price", "images", "attributes", "variants", "ts")]
    new = valid.groupBy(*KEY).agg(*filled, *whole)

    products = tx.read("products")
    by_sku = products.where(X.blank_to_null(F.col("sku")).isNotNull()).groupBy("storeId", "sku").agg(F.min("id").alias("sku_id"))
    old = products.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in ("id", "canonicalProductId", *FILLED)])
    joined = new.join(old, KEY, "left").join(by_sku, ["storeId", "sku"], "left")
    merged = joined.withColumns({c: F.coalesce(c, f"old_{c}") for c in FILLED} | {"id": F.coalesce("old_id", "sku_id", "id")})
    merged = merged.withColumns({"canonicalProductId": X.canonical_id(F.col("title"), F.col("brand")), "status": F.lit("active"), "lastSyncedAt": F.col("ts")})
    moved = merged.select(F.explode(F.array("canonicalProductId", "old_canonicalProductId")).alias("canonicalId")).where("canonicalId is not null").distinct()
    # These are asked for after the products have changed, so they are written before.
    tx.write_side("moved", moved)
    tx.change("products", merged.select(products.columns), _replaced(KEY))

    # Every valid event sets the offers of its own variants.
    each = valid.select(*KEY, "ts", "event_id", F.explode("variants").alias("v")).withColumn("variantId", F.col("v.variantId"))
    own = tx.read("products").select(F.col("id").alias("productId"), *KEY, "canonicalProductId")
    stock = F.when(F.col("v.inventoryQty").isNull(), F.coalesce("v.isInStock", F.lit(False))).otherwise(F.col("v.inventoryQty") > 0)
    offers = _last(each, [*KEY, "variantId"]).join(own, KEY).select(
        F.concat_ws("_", F.lit("offer"), "storeId", "sourceId", "variantId").alias("id"), "productId", *KEY, "variantId", "v.sku", "v.price",
        "v.currency", F.col("v.inventoryQty").alias("stockQty"), stock.alias("isInStock"), F.when(stock, "in_stock").otherwise("out_of_stock").alias("availability"),
        "canonicalProductId", F.col("ts").alias("lastSyncedAt"),
    )
    tx.change("offers", offers, _offers_merged)
    refresh_canonical(tx, tx.read_side("moved"))


def _offers_merged(now: DataFrame, new: DataFrame) -> DataFrame:
    """Offers of the same variant are replaced; others of the product take its canonical id."""
    of = new.groupBy(*KEY).agg(F.max("canonicalProductId").alias("of"), F.lit(True).alias("hit"))
    rest = now.join(new.select(*KEY, "variantId"), [*KEY, "variantId"], "left_anti").join(of, KEY, "left")
    rest = rest.withColumn("canonicalProductId", F.when(F.col("hit"), F.col("of")).otherwise(F.col("canonicalProductId")))
    return rest.select(now.columns).unionByName(new.select(now.columns))


def refresh_canonical(tx: Transaction, ids: DataFrame) -> None:
    """Canonical rows of ``ids`` (canonicalId) anew from their products, with the price range of their offers."""
    of = lambda rows: rows.join(ids.select(F.col("canonicalId").alias("canonicalProductId")), "canonicalProductId", "left_semi")
    rows = canonical_merge(of(tx.read("products")))
    tx.change("canonical", O.price_range_sync(rows, of(tx.read("offers"))), _replaced(["canonicalId"]))


def run(stream: DataFrame, log: CommitLog, change: Callable[[Transaction, DataFrame], None], checkpoint: str) -> None:
    """Applies what is there of a stream, a commit for each batch; goes on where an earlier run with this checkpoint stopped."""

    def each(batch: DataFrame, number: int) -> None:
        def apply(tx: Transaction) -> None:
            tx.write_side("batch", batch)  # read several times
            change(tx, tx.read_side("batch"))

        log.apply(number, apply)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def inventory_events(tx: Transaction, events: DataFrame) -> None:
    """Inventory events (storeId, sku, quantity, ts, event_id): offers and variants of the SKU in the store; no quantity is in stock."""
    last = _last(events.where("storeId is not null and sku is not null"), ["storeId", "sku"]).select("storeId", "sku", "quantity", F.col("ts").alias("at"))
    stock = F.coalesce(F.col("quantity") > 0, F.lit(True))
    hit = tx.read("offers").join(last, ["storeId", "sku"])
    tx.change("offers", hit.withColumns({
        "stockQty": F.col("quantity"), "isInStock": stock, "availability": F.when(stock, "in_stock").otherwise("out_of_stock"), "lastSyncedAt": F.col("at"),
    }), _replaced(["id"]))
    each = tx.read("products").select(*KEY, F.posexplode("variants").alias("i", "v"))
    patched = each.join(last, (each["storeId"] == last["storeId"]) & (each["v.sku"] == last["sku"])).select(each["sourceId"], each["storeId"], "i", "quantity", "at")
    by_product = patched.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("quantity")))).alias("new"), F.max("at").alias("at"))
    quantity = lambda i: F.try_element_at("new", i)
    patch = lambda v, i: F.when(quantity(i).isNull(), v).otherwise(
        v.withField("inventoryQty", quantity(i)["quantity"]).withField("isInStock", F.coalesce(quantity(i)["quantity"] > 0, F.lit(True)))
    )
    rows = tx.read("products").join(by_product, KEY).withColumns({"variants": F.transform("variants", patch), "lastSyncedAt": F.col("at")})
    tx.change("products", rows, _replaced(KEY))


def delete_events(tx: Transaction, events: DataFrame) -> None:
    """Delete events (source, sourceId, storeId, ts, event_id): products go inactive, their offers out of stock."""
    last = _last(events.where("sourceId is not null and storeId is not null"), ["source", *KEY]).select("source", *KEY, F.col("ts").alias("at"))
    rows = tx.read("products").join(last, ["source", *KEY]).withColumns({"status": F.lit("inactive"), "lastSyncedAt": F.col("at")})
    tx.write_side("gone", rows.select(*KEY, "at"))
    tx.change("products", rows, _replaced(KEY))
    out = {"isInStock": F.lit(False), "availability": F.lit("out_of_stock"), "lastSyncedAt": F.col("at")}
    tx.change("offers", tx.read("offers").join(tx.read_side("gone"), KEY).withColumns(out), _replaced(["id"]))


def latest_arrivals(name: str, key: str, hours: float | None = None) -> Callable[[Transaction, DataFrame], None]:
    """A handler that keeps, of each ``key``, the row that arrived last, whatever time it speaks of.

    Rows carry ``received`` (when they came) and ``event_id`` (their order where that is equal). The state is the table
    ``name`` of the log, a row for each key, not a state store; with ``hours``, what came longer before the batch's last
    row goes when its bucket is written anew, and ``fresh`` leaves it out of what is read. Rows without a key are left out.
    """
    def handle(tx: Transaction, batch: DataFrame) -> None:
        order = F.struct("received", "event_id")
        new = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("e")).select("e.*")
        now = batch.agg(F.max("received")).first()[0]
        tx.change(name, new, lambda held, rows: fresh(_replaced([key])(held, rows), now, hours))

    return handle


def fresh(rows: DataFrame, now, hours: float | None) -> DataFrame:
    """Rows that were received within ``hours`` before ``now``; all without either."""
    if hours is None or now is None:
        return rows
    return rows.where(F.col("received") > F.lit(now) - F.make_dt_interval(secs=F.lit(hours * 3600)))

"""Commerce tables as views over the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import exprs as X
from shelfmark.sources.tables import parts, spread, table

SOURCES = list(X.SOURCE_PRIORITY)
CURRENCIES = ["INR", "USD", "EUR"]
#: Rows of a task: of products, which become payloads, pages and texts, and of order lines, which become offers.
PRODUCT_ROWS, LINE_ROWS = 10_000, 250_000
TOPICS = {"signup": "create", "click": "update", "purchase": "inventory", "error": "delete", "view": "unhandled"}


def pick(values: list[str], number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (number + 1).cast("int"))


def stores(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf, "supplier").join(F.broadcast(nation), "s_nationkey").select(
        F.concat(F.lit("store_"), F.col("s_suppkey").cast("string")).alias("id"),
        F.col("s_name").alias("name"),
        pick(SOURCES, F.col("s_suppkey") % 6).alias("platform"),
        pick(CURRENCIES, F.col("s_nationkey") % 3).alias("currency"),
        F.col("n_name").alias("country"),
        (F.col("s_suppkey") % 7 != 0).alias("isActive"),
        F.lit("secret").alias("credentials"),
    )


def products(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    price = F.col("p_retailprice") * (1 + F.col("p_size") / 50.0)
    brand = F.when(key % 10 != 0, F.col("p_brand"))
    text = key.cast("string")
    sku = F.when(key % 4 == 0, F.concat(F.lit("SKU-"), text))
    currency = pick(CURRENCIES, key % 3)
    return spread(table(spark, sf, "part"), PRODUCT_ROWS, "p_partkey").select(
        F.concat(F.lit("prod_"), text).alias("id"),
        text.alias("sourceId"),
        pick(SOURCES, key % 6).alias("source"),
        F.concat(F.lit("store_"), (key % 10).cast("string")).alias("storeId"),
        sku.alias("sku"),
        F.when(key % 41 != 0, F.col("p_name")).alias("title"),
        brand.alias("brand"),
        F.when(key % 17 != 0, F.col("p_type")).alias("category"),
        F.when(key % 5 != 0, F.concat_ws(" by ", F.col("p_name"), F.col("p_brand"))).alias("description"),
        F.when(key % 11 == 0, "inactive").otherwise("active").alias("status"),
        price.alias("price"),
        currency.alias("currency"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("attributes"),
        F.when(key % 20 != 0, F.array(F.concat(F.lit("https://img.example.com/"), text, F.lit(".jpg")))).otherwise(F.array().cast("array<string>")).alias("images"),
        F.timestamp_add("HOUR", key, F.lit("2024-01-01").cast("timestamp")).alias("lastSyncedAt"),
        X.canonical_id(F.when(key % 41 != 0, F.col("p_name")), brand).alias("canonicalProductId"),
    )


def offers(spark: SparkSession, sf: str) -> DataFrame:
    lines = spread(table(spark, sf, "lineitem"), LINE_ROWS, "l_partkey")  # also the parts of the join with products
    grouped = lines.groupBy("l_partkey", "l_suppkey").agg(
        F.min("l_extendedprice").alias("price"),
        (F.sum("l_quantity").cast("long") % 30).alias("stockQty"),
        F.max("l_shipdate").cast("timestamp").alias("lastSyncedAt"),
    )
    own = products(spark, sf).select(F.col("sourceId").cast("long").alias("l_partkey"), "canonicalProductId")
    availability = X.availability_threshold(F.col("stockQty"))
    return grouped.join(own, "l_partkey").select(
        F.concat_ws("_", F.lit("offer"), "l_partkey", "l_suppkey").alias("id"),
        F.concat(F.lit("prod_"), F.col("l_partkey").cast("string")).alias("productId"),
        F.concat(F.lit("store_"), F.col("l_suppkey").cast("string")).alias("storeId"),
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku"),
        "price",
        pick(CURRENCIES, F.col("l_suppkey") % 3).alias("currency"),
        availability.alias("availability"),
        (availability != "out_of_stock").alias("isInStock"),
        "stockQty",
        "lastSyncedAt",
        "canonicalProductId",
    )


def offer_parts(spark: SparkSession, sf: str) -> int:
    """The parts that offers come in, for steps that deal all of them anew."""
    return parts(table(spark, sf, "lineitem"), LINE_ROWS)


def payload_parts(spark: SparkSession, sf: str) -> int:
    """The same of the payloads of all platforms."""
    return parts(table(spark, sf, "part"), PRODUCT_ROWS)


def webhooks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("webhookId"),
        X.literal_map(TOPICS)[F.col("event_type")].alias("topic"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        "user_id",
        "value",
    )


def sync_metrics(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "partial").otherwise("success")
    return table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("store_"), (F.col("user_id") % 100).cast("string")).alias("storeId"),
        pick(SOURCES, F.col("user_id") % 6).alias("platform"),
        status.alias("status"),
        F.floor("value").cast("long").alias("successProducts"),
        F.floor(F.col("value") * 1000).cast("long").alias("durationMs"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def api_calls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("endpoint"),
        (F.col("event_type") == "error").alias("isError"),
        F.floor(F.col("value") * 10).cast("long").alias("durationMs"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def as_of(spark: SparkSession, sf: str):
    """The time of the last event, which stands for now."""
    return table(spark, sf, "events").agg(F.max("ts").cast("timestamp")).first()[0]

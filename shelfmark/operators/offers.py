"""Offers joined with stores and products, and summed up per canonical product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import exprs as X


def join_offer_store(offers: DataFrame, stores: DataFrame) -> DataFrame:
    """Offers with their store's name and platform, null for an unknown store."""
    own = stores.select(F.col("id").alias("storeId"), F.col("name").alias("storeName"), F.col("platform"))
    return offers.join(own, "storeId", "left")


def join_offer_product(offers: DataFrame, canonical: DataFrame) -> DataFrame:
    """Offers with the title and brand of their canonical product."""
    return offers.join(canonical.select(F.col("canonicalId").alias("canonicalProductId"), "title", "brand"), "canonicalProductId", "left")


def join_offer_canonical_backfill(offers: DataFrame, products: DataFrame) -> DataFrame:
    """Offers whose empty canonical id is filled from their product; ``backfilled`` tells which."""
    own = products.select(F.col("id").alias("productId"), F.col("canonicalProductId").alias("known"))
    had = X.blank_to_null(F.col("canonicalProductId"))
    joined = offers.join(own, "productId", "left")
    return joined.withColumn("backfilled", had.isNull() & F.col("known").isNotNull()).withColumn("canonicalProductId", F.coalesce(had, "known")).drop("known")


def modal_currency(offers: DataFrame) -> DataFrame:
    """Most frequent currency of each canonical product; of equals the first to get there in price order."""
    counted = offers.where("canonicalProductId is not null and price is not null").groupBy("canonicalProductId", F.upper("currency").alias("currency")).agg(
        F.count("*").alias("n"), F.max(F.struct("price", "id")).alias("last")
    )
    # Of equally frequent ones that whose last offer comes first got to its number first.
    best = F.min_by("currency", F.struct(-F.col("n"), "last"))
    return counted.groupBy("canonicalProductId").agg(best.alias("currency"))


def offer_summary(offers: DataFrame) -> DataFrame:
    """Lowest and highest price, modal currency, in-stock stores and counts of each canonical product."""
    usable = offers.where("canonicalProductId is not null and price is not null")
    in_stock = F.col("availability").isin(X.SUMMARY_IN_STOCK)
    summed = usable.groupBy("canonicalProductId").agg(
        F.min("price").alias("lowestPrice"),
        F.max("price").alias("highestPrice"),
        F.count("*").alias("totalOffers"),
        F.count_if(in_stock).alias("inStockCount"),
        F.count_distinct(F.when(in_stock, F.col("storeId"))).alias("availableStores"),
    )
    return summed.join(modal_currency(offers), "canonicalProductId")


def bulk_offer_summary(ids: DataFrame, offers: DataFrame) -> DataFrame:
    """The summary of each id of ``ids``; zeros for one without offers."""
    wanted = ids.select("canonicalProductId").distinct()
    found = wanted.join(offer_summary(offers.join(wanted, "canonicalProductId", "left_semi")), "canonicalProductId", "left")
    return found.fillna(0, ["totalOffers", "inStockCount", "availableStores"])


def offer_list(offers: DataFrame, stores: DataFrame) -> DataFrame:
    """Offers of each canonical product in price order with their rank and store name."""
    named = join_offer_store(offers.where("canonicalProductId is not null and price is not null"), stores)
    rank = F.row_number().over(Window.partitionBy("canonicalProductId").orderBy("price", "id"))
    return named.select("canonicalProductId", rank.alias("position"), "id", "storeName", "price", "availability")


def offer_by_product(offers: DataFrame) -> DataFrame:
    """Cheapest and dearest store of each canonical product and whether any has it in stock."""
    usable = offers.where("canonicalProductId is not null and price is not null")
    return usable.groupBy("canonicalProductId").agg(
        F.min("price").alias("minPrice"),
        F.max("price").alias("maxPrice"),
        F.min_by("storeId", F.struct("price", "id")).alias("minStore"),
        F.min_by("storeId", F.struct(-F.col("price"), "id")).alias("maxStore"),
        F.bool_or(F.col("availability").isin(X.PRODUCT_IN_STOCK)).alias("inStock"),
        F.count("*").alias("totalOffers"),
    )


def price_range_sync(canonical: DataFrame, offers: DataFrame) -> DataFrame:
    """Canonical products with the price range of their offers, which replaces the one they had."""
    summary = offer_summary(offers).select(
        F.col("canonicalProductId").alias("canonicalId"), F.col("lowestPrice").alias("newMin"), F.col("highestPrice").alias("newMax"), F.col("currency").alias("newCurrency")
    )
    joined = canonical.join(summary, "canonicalId", "left")
    return joined.select(
        *[c for c in canonical.columns if c not in ("priceMin", "priceMax", "currency")],
        F.coalesce("newMin", "priceMin").alias("priceMin"), F.coalesce("newMax", "priceMax").alias("priceMax"), F.coalesce("newCurrency", "currency").alias("currency"),
    )


def offer_rollup_totals(offers: DataFrame) -> DataFrame:
    """Products, offers, products with several offers, offers per product to two places."""
    per = offers.where("canonicalProductId is not null and price is not null").groupBy("canonicalProductId").count()
    return per.agg(
        F.count("*").alias("products"),
        F.sum("count").alias("offers"),
        F.count_if(F.col("count") > 1).alias("multiOfferProducts"),
        F.round(F.sum("count") / F.count("*"), 2).alias("averageOffers"),
    )

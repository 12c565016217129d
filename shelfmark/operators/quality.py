"""Data-quality rules over canonical products, and the history of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import exprs as X


def issues_of(rows: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per product and rule that holds: canonicalProductId, issueCode, severity."""
    made = [F.when(rule, F.struct(F.lit(code).alias("issueCode"), F.lit(severity).alias("severity"))) for code, severity, rule in rules]
    return rows.select(F.col("canonicalId").alias("canonicalProductId"), F.inline(F.array_compact(F.array(*made))))


def dq_schema(canonical: DataFrame) -> DataFrame:
    title = F.coalesce(X.blank_to_null(F.col("title")), F.lit(""))
    lo, hi = F.col("priceMin"), F.col("priceMax")
    return issues_of(canonical, [
        ("MISSING_PRICE", "critical", lo.isNull() & hi.isNull()),
        ("INVALID_PRICE_VALUE", "critical", (lo <= 0) | (hi <= 0)),
        ("INVALID_PRICE_RANGE", "critical", lo > hi),
        ("MISSING_TITLE", "critical", title == ""),
        ("TITLE_TOO_LONG", "critical", F.length(title) > 500),
        ("INVALID_TITLE", "critical", (title != "") & ~title.rlike("[A-Za-z]")),
        ("MISSING_IMAGES", "warning", F.size("images") == 0),
        ("INVALID_IMAGE_URL", "warning", F.exists("images", lambda u: ~u.rlike("^https?://"))),
        ("INVALID_CURRENCY", "warning", F.col("currency").isNotNull() & ~F.col("currency").rlike("^[A-Z]{3}$")),
        ("MISSING_BRAND", "warning", X.blank_to_null(F.col("brand")).isNull()),
    ])


def price_change(canonical: DataFrame, baseline: DataFrame) -> DataFrame:
    """canonicalId, the share by which the minimum price moved from the stored one, null without one or at zero."""
    joined = canonical.join(baseline.select("canonicalId", "price_history"), "canonicalId", "left")
    share = F.when(F.col("price_history") > 0, F.abs(F.col("priceMin") - F.col("price_history")) / F.col("price_history"))
    return joined.select("canonicalId", "priceMin", "price_history", share.alias("change"))


def dq_anomaly(canonical: DataFrame, offers: DataFrame, baseline: DataFrame, as_of, stale_days: int = 30) -> DataFrame:
    counted = offers.where("canonicalProductId is not null").groupBy(F.col("canonicalProductId").alias("canonicalId")).agg(
        F.count("*").alias("n"), F.count_if(F.col("availability").isin(X.QUALITY_IN_STOCK)).alias("stocked")
    )
    moved = price_change(canonical, baseline).select("canonicalId", "change")
    joined = canonical.join(counted, "canonicalId", "left").join(moved, "canonicalId", "left")
    n = F.coalesce("n", F.lit(0))
    return issues_of(joined, [
        ("ANOMALOUS_PRICE_CHANGE", "critical", F.col("change") > 0.5),
        ("NO_STOCK_AVAILABLE", "warning", (n > 0) & (F.col("stocked") == 0)),
        ("NO_OFFERS", "warning", n == 0),
        ("STALE_PRODUCT", "warning", F.col("updatedAt") < F.lit(as_of) - F.make_interval(days=F.lit(stale_days))),
    ])


def xjoin_sku_conflict(products: DataFrame) -> DataFrame:
    """SKUs under several canonical ids."""
    known = products.select(X.blank_to_null(F.col("sku")).alias("sku"), "canonicalProductId").where("sku is not null and canonicalProductId is not null")
    return known.groupBy("sku").agg(F.count_distinct("canonicalProductId").alias("canonicals")).where("canonicals > 1")


def dq_consistency(canonical: DataFrame, products: DataFrame) -> DataFrame:
    conflicts = products.join(xjoin_sku_conflict(products), "sku", "left_semi").select("canonicalProductId").distinct()
    brands = products.groupBy("canonicalProductId").agg(F.count_distinct(X.brand_normalize(F.col("brand"))).alias("brands")).where("brands > 1")
    issue = lambda df, code, severity: df.select("canonicalProductId", F.lit(code).alias("issueCode"), F.lit(severity).alias("severity"))
    without = canonical.where(F.size("sources") == 0).select(F.col("canonicalId").alias("canonicalProductId"))
    return (
        issue(conflicts.where("canonicalProductId is not null"), "SKU_CONFLICT", "critical")
        .unionByName(issue(brands.where("canonicalProductId is not null"), "BRAND_CONFLICT", "warning"))
        .unionByName(issue(without, "NO_SOURCES", "warning"))
    )


def dq_upsert(stored: DataFrame, detected: DataFrame, as_of) -> DataFrame:
    """Issue history: found again stays open from its first time, new is opened, no longer found is resolved."""
    keys = ["canonicalProductId", "issueCode"]
    now = F.lit(as_of)
    found = detected.select(*keys, F.col("severity").alias("new_severity")).distinct().withColumn("found", F.lit(True))
    joined = stored.join(found, keys, "full_outer")
    gone = F.col("found").isNull()
    return joined.select(
        *keys,
        F.coalesce("new_severity", "severity").alias("severity"),
        F.coalesce("detectedAt", now).alias("detectedAt"),
        gone.alias("resolved"),
        F.when(gone, F.coalesce("resolvedAt", now)).alias("resolvedAt"),
    )


def dq_run_summary(canonical: DataFrame, issues: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    products = canonical.select(F.lit(True).alias("product"), none.alias("severity"), none.alias("id"))
    found = issues.select(F.lit(False).alias("product"), "severity", F.col("canonicalProductId").alias("id"))
    return products.unionByName(found).agg(
        F.count_if("product").alias("checked"), F.count_if(~F.col("product")).alias("issues"), F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warning"), F.count_distinct("id").alias("productsWithIssues"),
    )


def dq_incremental(canonical: DataFrame, touched: DataFrame) -> DataFrame:
    """The schema rules for touched canonical ids only."""
    return dq_schema(canonical.join(touched.select("canonicalId").distinct(), "canonicalId", "left_semi"))


def dq_baseline_update(canonical: DataFrame, baseline: DataFrame) -> DataFrame:
    return canonical.join(baseline.select("canonicalId", "price_history"), "canonicalId", "left").select("canonicalId", F.coalesce("priceMin", "price_history").alias("price_history"))


def dq_resolve_manual(history: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Issues of ``ids`` (canonicalProductId, issueCode) resolved by hand."""
    asked = ids.distinct().withColumn("asked", F.lit(True))
    joined = history.join(asked, ["canonicalProductId", "issueCode"], "left")
    return joined.withColumns({
        "resolvedAt": F.when(F.col("asked") & ~F.col("resolved"), F.lit(as_of)).otherwise(F.col("resolvedAt")),
        "resolved": F.col("resolved") | F.col("asked").isNotNull(),
    }).drop("asked")


def filter_issues(issues: DataFrame, severity: str | None = None, resolved: bool = False) -> DataFrame:
    kept = issues.where(F.col("resolved") == resolved)
    return kept.where(F.col("severity") == severity) if severity else kept


STATUSES = ["active", "inactive", "draft", "archived"]
#: Longest texts of a product.
LONGEST = {"title": 500, "description": 10_000, "brand": 200, "category": 200, "currency": 3}


def validate_products(products: DataFrame) -> DataFrame:
    """Products with the list of rules they break, empty for valid ones; rules on columns that a table lacks are left out."""
    blank = lambda c: X.blank_to_null(F.col(c)).isNull()
    no_url = lambda i: ~F.coalesce(i.rlike("^https?://"), F.lit(False))
    of_variants = lambda broken: F.exists("variants", broken)
    rules = [
        ("required:sourceId", "sourceId", lambda: blank("sourceId")),
        ("required:title", "title", lambda: blank("title")),
        ("maxLength:title", "title", lambda: F.length("title") > LONGEST["title"]),
        ("enum:source", "source", lambda: ~F.col("source").isin(list(X.SOURCE_PRIORITY))),
        ("enum:status", "status", lambda: ~F.col("status").isin(STATUSES)),
        ("minimum:price", "price", lambda: F.col("price") < 0),
        ("pattern:currency", "currency", lambda: ~F.col("currency").rlike("^[A-Z]{3}$")),
        ("required:id", "id", lambda: blank("id")),
        ("required:source", "source", lambda: blank("source")),
        ("required:storeId", "storeId", lambda: blank("storeId")),
        ("required:status", "status", lambda: blank("status")),
        ("required:lastSyncedAt", "lastSyncedAt", lambda: F.col("lastSyncedAt").isNull()),
        ("maxLength:description", "description", lambda: F.length("description") > LONGEST["description"]),
        ("maxLength:brand", "brand", lambda: F.length("brand") > LONGEST["brand"]),
        ("maxLength:category", "category", lambda: F.length("category") > LONGEST["category"]),
        ("format:images", "images", lambda: F.exists("images", no_url)),
        ("minItems:variants", "variants", lambda: F.coalesce(F.size("variants"), F.lit(0)) < 1),
        ("required:variantId", "variants", lambda: of_variants(lambda v: X.blank_to_null(v["variantId"]).isNull())),
        ("required:variantPrice", "variants", lambda: of_variants(lambda v: v["price"].isNull())),
        ("minimum:variantPrice", "variants", lambda: of_variants(lambda v: F.coalesce(v["price"] < 0, F.lit(False)))),
        ("pattern:variantCurrency", "variants", lambda: of_variants(lambda v: ~F.coalesce(v["currency"].rlike("^[A-Z]{3}$"), F.lit(False)))),
    ]
    held = [F.when(rule(), F.lit(name)) for name, column, rule in rules if column in products.columns]
    return products.withColumn("errors", F.array_compact(F.array(*held)))


def orphan_offers(products: DataFrame, offers: DataFrame) -> DataFrame:
    """storeId, orphanOffers: offers whose product doesn't exist, per store."""
    orphans = offers.join(products.select(F.col("id").alias("productId")), "productId", "left_anti")
    return orphans.groupBy("storeId").agg(F.count("*").alias("orphanOffers"))


def ingest_completeness(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Counters per source and store."""
    blank = lambda c: X.blank_to_null(F.col(c)).isNull()
    checked = validate_products(products)
    counted = checked.groupBy("source", "storeId").agg(
        F.count("*").alias("total"), F.count_if(F.size("errors") > 0).alias("invalid"), F.count_if(blank("brand")).alias("missingBrands"),
        F.count_if(blank("sku")).alias("missingSkus"), F.count_if(F.col("canonicalProductId").isNotNull()).alias("mapped"),
        (F.count("*") - F.count_distinct("canonicalProductId") - F.count_if(F.col("canonicalProductId").isNull())).alias("duplicates"),
    )
    return counted

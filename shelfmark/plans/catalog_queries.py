"""Queries over category trees, keyed tables and assistant views."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import exprs as X
from shelfmark.operators import categories as K
from shelfmark.operators import normalize as N
from shelfmark.operators import pages as G
from shelfmark.operators import quality as Q
from shelfmark.operators import resolve as R
from shelfmark.operators import serve as V
from shelfmark.operators import survive as S
from shelfmark.operators import upsert as U
from shelfmark.plans import payloads, views
from shelfmark.plans.queries import QUERIES as BASE
from shelfmark.plans.queries import canonical, issues
from shelfmark.sources.tables import table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def category_rows(spark, sf):
    """Regions, nations and suppliers as a tree of three levels."""
    row = lambda df, key, name, parent: df.select(key.alias("sourceId"), name.alias("name"), parent.alias("parentSourceId"))
    c, text = F.col, lambda x: F.col(x).cast("string")
    regions = row(table(spark, sf, "region"), F.concat(F.lit("r"), text("r_regionkey")), c("r_name"), F.lit(None).cast("string"))
    nations = row(table(spark, sf, "nation"), F.concat(F.lit("n"), text("n_nationkey")), c("n_name"), F.concat(F.lit("r"), text("n_regionkey")))
    suppliers = row(table(spark, sf, "supplier"), F.concat(F.lit("s"), text("s_suppkey")), c("s_name"), F.concat(F.lit("n"), text("s_nationkey")))
    return regions.unionByName(nations).unionByName(suppliers)


@query
def join_parent_category(spark, sf):
    return K.join_parent_category(category_rows(spark, sf)).select("sourceId", "name", "id", "parentId")


@query
def norm_woo_categories(spark, sf):
    rows = category_rows(spark, sf)
    return K.norm_woo_categories(rows.withColumn("parentSourceId", F.coalesce("parentSourceId", F.lit("0"))))


@query
def norm_shopify_categories(spark, sf):
    rows = category_rows(spark, sf).withColumn("productsCount", F.when(F.length("sourceId") == 2, F.length("name")))
    return K.norm_shopify_categories(rows)


@query
def norm_bigcommerce_categories(spark, sf):
    rows = category_rows(spark, sf)
    return K.norm_bigcommerce_categories(rows.select("sourceId", "name", F.coalesce("parentSourceId", F.lit("0")).alias("parentSourceId"), F.concat(F.lit("/"), "name", F.lit("/")).alias("url")))


@query
def norm_magento_categories(spark, sf):
    text = lambda x: F.col(x).cast("string")
    leaves = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.concat(F.lit("s"), text("s_suppkey")).alias("id"), F.col("s_name").alias("name"))).alias("children_data"))
    nations = table(spark, sf, "nation").join(leaves, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    node = F.struct(F.concat(F.lit("n"), text("n_nationkey")).alias("id"), F.col("n_name").alias("name"), "children_data")
    trees = nations.groupBy("n_regionkey").agg(F.to_json(F.struct(F.first(F.concat(F.lit("r"), text("n_regionkey"))).alias("id"), F.collect_list(node).alias("children_data"))).alias("tree"))
    return K.norm_magento_categories(trees)


def _links(spark, sf):
    products = payloads.raw(spark, sf, "woocommerce").select(F.col("id").cast("string").alias("id"), F.array(F.concat(F.lit("n"), (F.col("id") % 30).cast("string")), F.concat(F.lit("r"), (F.col("id") % 5).cast("string"))).alias("raw"))
    return K.link_categories(products, "raw", K.join_parent_category(category_rows(spark, sf)))


@query
def join_woo_categories(spark, sf):
    return _links(spark, sf).select("id", F.array_join("categoryIds", ",").alias("categoryIds"), "missing")


@query
def unmatched_categories(spark, sf):
    return K.unmatched_categories(_links(spark, sf)).select("id", "missing")


@query
def validate_categories(spark, sf):
    rows = category_rows(spark, sf).withColumn("name", F.when(F.length("sourceId") > 2, F.col("name")))
    return K.validate_categories(rows).select("sourceId", F.array_join("errors", ",").alias("errors"))


@query
def resolve_variants(spark, sf):
    products = views.products(spark, sf).where("canonicalProductId is not null")
    one = lambda w: products.where(w).groupBy(F.col("canonicalProductId").alias("canonicalId"), (F.col("sourceId").cast("long") % 7).cast("string").alias("variantId")).agg(
        F.min_by(F.struct(F.lit(None).cast("string").alias("sku"), F.when(F.col("price") < 1400, F.col("price")).alias("price"), "status", X.source_priority(F.col("source")).alias("priority")), "id").alias("v")
    ).select("canonicalId", "variantId", "v.sku", "v.price", F.col("v.status").alias("availability"), "v.priority")
    return S.resolve_variants(one("sourceId % 2 = 0"), one("sourceId % 2 = 1")).select("canonicalId", "variantId", "price", "availability", "state")


@query
def upsert_offer_keys(spark, sf):
    base = views.offers(spark, sf)
    products = views.products(spark, sf)
    old = base.select(F.substring_index("productId", "_", -1).alias("sourceId"), F.concat(F.lit("store_"), (F.substring_index("productId", "_", -1).cast("long") % 10).cast("string")).alias("storeId"), F.when(F.col("stockQty") % 3 != 0, F.col("id")).alias("variantId"), "price", "productId")
    new = base.select(F.substring_index("productId", "_", -1).alias("sourceId"), F.concat(F.lit("store_"), (F.substring_index("productId", "_", -1).cast("long") % 10).cast("string")).alias("storeId"), F.when(F.col("stockQty") % 5 != 0, F.col("id")).alias("variantId"), (F.col("price") + 1).alias("price")).where("price < 20000")
    return U.upsert_offer_keys(old, new, products).select("sourceId", "storeId", "variantId", "price", "productId")


@query
def array_element_patch(spark, sf):
    products = N.norm_shopify_products(payloads.raw(spark, sf, "shopify"), "s1").select("id", "sourceId", "variants")
    patches = views.offers(spark, sf).groupBy("sku").agg(F.max("stockQty").alias("quantity"))
    patched = U.array_element_patch(products, patches)
    return patched.select("sourceId", F.get("variants", 0)["inventoryQty"].alias("first"), F.get("variants", 1)["inventoryQty"].alias("second"), F.get("variants", 0)["isInStock"].alias("stocked"))


@query
def raw_archive(spark, sf):
    landed = payloads.bronze(spark, sf)
    old = landed.where("platform in ('magento', 'unicommerce') and sourceId < '5'").withColumn("sourceId", F.coalesce(F.get_json_object("payload", "$.id"), F.get_json_object("payload", "$.itemTypeSKU"))).withColumn("payload", F.lit("{}"))
    done = U.raw_archive(old, landed.where("platform <> 'unicommerce'").select("platform", "payload"), parts=views.payload_parts(spark, sf))
    return done.select("platform", "sourceId", (F.col("payload") == "{}").alias("untouched"))


@query
def dead_letter_log(spark, sf):
    failed = views.sync_metrics(spark, sf).where("status = 'failed'").select(F.col("event_id").alias("jobId"), F.lit("pending_review").alias("state"), F.col("ts").alias("failedAt"), F.lit(None).cast("timestamp").alias("resolvedAt"))
    old, new = failed.where("jobId % 3 <> 0"), failed.where("jobId % 2 = 0")
    return U.dead_letter_log(old, new, failed.where("jobId % 5 = 0"), views.as_of(spark, sf))


@query
def join_canonical_full(spark, sf):
    return V.join_canonical_full(canonical(spark, sf), views.products(spark, sf), views.offers(spark, sf))


@query
def search_context(spark, sf):
    found = canonical(spark, sf).where("title like '%ring%'")
    return V.search_context(found, "ring")


@query
def ai_search_view(spark, sf):
    found = V.search_suggest(canonical(spark, sf), "ri", 5)
    results = found.join(canonical(spark, sf).select("canonicalId", "category"), "canonicalId")
    return V.ai_search_view(results, views.offers(spark, sf))


@query
def redact_secrets(spark, sf):
    rows = views.stores(spark, sf).select("id", F.create_map(F.lit("api_key"), F.col("credentials"), F.lit("country"), F.col("country")).alias("meta"))
    return V.redact_secrets(rows, "meta").select("id", F.col("meta")["api_key"].alias("key"), F.col("meta")["country"].alias("country"))


@query
def dq_ai_contract(spark, sf):
    view = V.ai_product_view(canonical(spark, sf), views.offers(spark, sf))
    broken = view.withColumn("brand", F.nullif("brand", F.lit(""))).withColumn("category", F.nullif("category", F.lit("Uncategorized")))
    return V.dq_ai_contract(broken)


@query
def next_page(spark, sf):
    return G.next_page(table(spark, sf, "pages"))


@query
def extract_domain_rules(spark, sf):
    pages = table(spark, sf, "pages")
    rules = pages.select(G.domain_of(F.col("url")).alias("domain")).distinct().where("domain like '%.com'").select("domain", F.lit("lang").alias("field"), F.lit('<html lang="([a-z]+)').alias("pattern"))
    return G.extract_domain_rules(pages, rules)


@query
def offers_magento(spark, sf):
    return N.offers_magento(N.norm_magento_products(payloads.raw(spark, sf, "magento"), "s2", payloads.BASE_URL))


@query
def scraped_pipeline(spark, sf):
    """Products extracted from pages: duplicates of the catalog, and new canonical products."""
    extracted = BASE["extract_cascade"](spark, sf)
    named = extracted.select("page_id", X.canonical_id(F.col("title"), F.col("brand")).alias("canonicalId"), "price", "currency")
    known = canonical(spark, sf).where("productCount > 1").select("canonicalId", F.lit(True).alias("known"))
    joined = named.join(known, "canonicalId", "left")
    return joined.groupBy("canonicalId").agg(F.min("price").alias("lowest"), F.count("*").alias("offers"), F.coalesce(F.first("known"), F.lit(False)).alias("known"))




@query
def offers_bigcommerce(spark, sf):
    k = F.col("id") % 3
    items = payloads.raw(spark, sf, "bigcommerce").withColumns({
        "inventory_tracking": F.when(k == 0, "none").when(k == 1, "variant").otherwise("product"),
        "sale_price": F.when(F.col("id") % 4 == 0, F.col("price") - 100), "retail_price": F.when(F.col("id") % 2 == 0, F.col("price") + 50),
    })
    return N.offers_bigcommerce(items, "s4")


@query
def norm_webhook_rest(spark, sf):
    events = views.products(spark, sf).select(
        F.when(F.col("sourceId").cast("long") % 2 == 0, F.col("sourceId")).otherwise(F.concat(F.lit("gid://shopify/Product/"), "sourceId")).alias("id"), "title", F.col("brand").alias("vendor"),
        F.lit("a, b ,").alias("tags"), F.when(F.col("currency") != "USD", F.col("currency")).alias("currency"),
    )
    return N.norm_webhook_rest(events).withColumn("tags", F.array_join("tags", "|"))


@query
def norm_scraped(spark, sf):
    return payloads.flat(N.norm_scraped(BASE["extract_cascade"](spark, sf)).withColumns({c: F.lit(None).cast("string") for c in ("category", "sku", "updatedAt")}).withColumn("images", F.array())).select("sourceId", "cleanedTitle", "normalizedBrand", "price", "status")


@query
def join_inventory_item(spark, sf):
    p = views.products(spark, sf).select(F.col("sourceId").cast("long").alias("item"), "sku").where("sku is not null")
    events = views.webhooks(spark, sf).where("topic = 'inventory'").select("event_id", F.col("user_id").alias("item"))
    return N.join_inventory_item(events, p.where("item % 8 = 0"), p.withColumn("sku", F.concat("sku", F.lit("-b"))))


def _collections(spark, sf):
    return views.products(spark, sf).select("id", F.concat(F.lit("n"), (F.length("title") % 25).cast("string")).alias("sourceId"))


@query
def join_shopify_collections(spark, sf):
    """Collection ids added to those that products have."""
    known = K.join_parent_category(category_rows(spark, sf)).select("sourceId", F.col("id").alias("categoryIds"))
    links = _collections(spark, sf).join(known, "sourceId").select("id", "categoryIds")
    have = views.products(spark, sf).select("id", F.array(F.lit("own")).alias("categoryIds"))
    return U.add_to_set(have, links, "id", "categoryIds").select("id", F.array_join("categoryIds", ",").alias("categoryIds"))


@query
def join_magento_categories(spark, sf):
    products = payloads.raw(spark, sf, "magento").select(F.col("id").cast("string").alias("id"), F.array(F.concat(F.lit("r"), (F.col("id") % 7).cast("string"))).alias("raw"))
    return K.link_categories(products, "raw", K.join_parent_category(category_rows(spark, sf))).select("id", F.array_join("categoryIds", ",").alias("categoryIds"), "missing")


@query
def page_issues(spark, sf):
    rows = Q.dq_upsert(issues(spark, sf), Q.dq_schema(canonical(spark, sf).where("priceMin < 1200")), views.as_of(spark, sf))
    return rows.where("not resolved").orderBy(F.desc("detectedAt"), "canonicalProductId", "issueCode").limit(20).select("canonicalProductId", "issueCode", "detectedAt")


@query
def er_block_join(spark, sf):
    """How many candidate pairs each category gives under a cap of 50."""
    rows = R.features(views.products(spark, sf))
    pairs = R.block_join(rows, F.nullif(F.col("category"), F.lit("")), 50)
    return pairs.groupBy("block").agg(F.count("*").alias("pairs"))


def accuracy_labels(spark, sf):
    """Pairs of equal brand and title, expected to match, and pairs of neighbours, expected not to."""
    p = views.products(spark, sf).where("brand is not null and title is not null")
    same = p.groupBy("brand", "title").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("a", "b", F.lit(True).alias("expected"))
    key = F.col("sourceId").cast("long")
    next_to = p.where(key % 3 == 0).select(F.col("id").alias("a"), F.concat(F.lit("prod_"), (key + 1).cast("string")).alias("b"), F.lit(False).alias("expected"))
    return same.unionByName(next_to)


@query
def accuracy_eval(spark, sf):
    return R.accuracy_eval(accuracy_labels(spark, sf), views.products(spark, sf))

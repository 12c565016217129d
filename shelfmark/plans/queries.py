"""The catalog queries: each binds an operator to the views of a folder of tables."""

from __future__ import annotations

import datetime as dt
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import metrics as M
from shelfmark.operators import offers as O
from shelfmark.operators import pages as G
from shelfmark.operators import quality as Q
from shelfmark.operators import resolve as R
from shelfmark.operators import serve as V
from shelfmark.operators import survive as S
from shelfmark.operators import upsert as U
from shelfmark.plans import views
from shelfmark.sources.tables import table

QUERIES = {}


def query(f):
    """Registers ``f``, whose parameters name the views it takes."""
    needs = list(inspect.signature(f).parameters)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(*[VIEWS[name](spark, sf_dir) for name in needs])

    QUERIES[f.__name__] = run
    return f


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    return S.canonical_merge(views.products(spark, sf))


def baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Stored minimum prices of some products, half of them much lower than now."""
    low = F.when(F.length("title") % 2 == 0, F.col("priceMin") * 0.5).otherwise(F.col("priceMin"))
    return canonical(spark, sf).where(F.length("title") % 3 != 0).select("canonicalId", low.alias("price_history"))


def pick(number, *forms):
    """One of the forms by the remainder of a number."""
    chosen = F.lit(forms[-1]) if isinstance(forms[-1], str) else forms[-1]
    for i in range(len(forms) - 2, -1, -1):
        chosen = F.when(number % len(forms) == i, forms[i]).otherwise(chosen)
    return chosen


def filled(form, *values):
    """``form`` with values in place of {0}, {1} and so on."""
    form = F.lit(form) if isinstance(form, str) else form
    for i, value in enumerate(values):
        form = F.replace(form, F.lit("{%d}" % i), value)
    return form


def product_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages made from products in all spellings: JSON-LD on even keys, OpenGraph on multiples of three."""
    key = F.col("sourceId").cast("long")
    brand, title = F.coalesce("brand", F.lit("")), F.coalesce("title", F.lit(""))
    plain, dotted = F.floor("price").cast("string"), F.format_number(F.floor("price"), 2)
    form = F.floor(key / 2)
    offer = filled(
        pick(form, '{"price": "{0}", "priceCurrency": "{1}"}', '[{"price": "{0}", "priceCurrency": "{1}"}, {"price": "1"}]', '{"priceSpecification": {"price": "{0}", "priceCurrency": "{1}"}}'),
        pick(form, plain, dotted, F.concat(F.lit("$"), dotted), F.concat(F.lit("from "), plain)), "currency",
    )
    named = filled(pick(form, '{"name": "{0}"}', '"{0}"', '{"@type": "Brand", "name": "{0}"}'), brand)
    product = filled('{"@type": {0}, "name": "{1}", "brand": {2}, "offers": {3}}', pick(form, '"Product"', '["Thing", "Product"]', '"product"', '["PRODUCT"]'), title, named, offer)
    wrapped = filled(
        pick(form, "{0}", "[{0}]", '{"@graph": [{"@type": "WebPage", "name": "Top"}, {0}]}', '[{"@type": "BreadcrumbList"}, {"@graph": [{0}]}]', "\n  {0}\n", '[[{"name": "x"}], {0}, {"@type": "Product", "name": "Other"}]'),
        product,
    )
    opened = pick(form, '<script type="application/ld+json">', "<SCRIPT id='a' type='application/ld+json'>", "<script type=application/ld+json class=b>")
    other = pick(form, "", '<script type="application/ld+json">{"@type": "Organization", "name": "Shop"}</script>', '<script type="application/ld+json">{"@type": "Product", "name": </script>', "<script>var p = 1;</script>")
    jsonld = F.concat(other, opened, wrapped, F.lit("</script>"))
    third = F.floor(key / 3)
    meta = pick(third, '<meta property="{0}" content="{1}">', "<meta content='{1}' property='{0}'/>", '<meta name="{0}" content="{1}" />', '<META class="m" property="{0}"\n content="{1}">', '<meta property={0} content="{1}" data-x="a>b">')
    tag = lambda name, value: filled(meta, F.lit(name), value)
    graph = F.concat(
        tag("og:title", title), pick(third, tag("product:price:amount", plain), tag("og:price:amount", dotted)), F.lit('<meta charset="utf-8">'),
        pick(third, tag("product:price:currency", F.col("currency")), tag("og:price:currency", F.col("currency"))), tag("product:brand", brand),
    )
    html = F.concat(F.lit("<html><head>"), F.when(key % 3 == 0, graph).otherwise(""), F.when(key % 2 == 0, jsonld).otherwise(""), F.lit("</head></html>"))
    return views.products(spark, sf).select(key.alias("page_id"), html.alias("html"))


def issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of an earlier run: the schema issues, every other one resolved."""
    found = Q.dq_schema(canonical(spark, sf))
    even = F.conv(F.substring("canonicalProductId", -1, 1), 16, 10).cast("int") % 2 == 0
    then = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    return found.select("canonicalProductId", "issueCode", "severity", then.alias("detectedAt"), even.alias("resolved"), F.when(even, then).alias("resolvedAt"))


VIEWS = {
    "products": views.products,
    "offers": views.offers,
    "stores": views.stores,
    "syncs": views.sync_metrics,
    "calls": views.api_calls,
    "now": views.as_of,
    "canonical": canonical,
    "baseline": baseline,
    "issues": issues,
    "product_pages": product_pages,
    "pages": lambda spark, sf: table(spark, sf, "pages"),
    "documents": lambda spark, sf: table(spark, sf, "documents"),
    "spark": lambda spark, sf: spark,
}

FLAT = ["canonicalId", "title", "brand", "category", "description", "productCount", "priceMin", "priceMax", "currency", "updatedAt"]


def flat(rows: DataFrame) -> DataFrame:
    """Canonical products with their scalar columns."""
    return rows.select(*FLAT, F.array_join("sources", ",").alias("sources"))


@query
def offer_summary(offers):
    return O.offer_summary(offers)


@query
def modal_currency(offers):
    return O.modal_currency(offers)


@query
def bulk_offer_summary(products, offers):
    return O.bulk_offer_summary(products.where("source = 'shopify' and canonicalProductId is not null"), offers)


@query
def offer_list(offers, stores):
    return O.offer_list(offers, stores)


@query
def offer_by_product(offers):
    return O.offer_by_product(offers)


@query
def price_range_sync(canonical, offers):
    return O.price_range_sync(canonical.select("canonicalId", "title", "priceMin", "priceMax", "currency"), offers)


@query
def offer_rollup_totals(offers):
    return O.offer_rollup_totals(offers)


@query
def join_offer_store(offers, stores):
    return O.join_offer_store(offers, stores).select("id", "storeName", "platform", "price")


@query
def join_offer_product(offers, canonical):
    return O.join_offer_product(offers, canonical).select("id", "title", "brand", "price")


@query
def join_offer_canonical_backfill(offers, products):
    missing = offers.withColumn("canonicalProductId", F.when(F.col("stockQty") % 3 != 0, F.col("canonicalProductId")))
    return O.join_offer_canonical_backfill(missing, products).select("id", "canonicalProductId", "backfilled")


@query
def canonical_merge(canonical):
    return flat(canonical)


@query
def golden_record(products):
    return S.golden_record(products)


def _sides(products):
    first = products.where("source in ('shopify', 'magento')").groupBy("canonicalProductId").agg(F.min_by(F.struct(*products.columns), "id").alias("r")).select("r.*")
    return first, products.where("source not in ('shopify', 'magento')")


@query
def resolve_product(products):
    return S.resolve_product(*_sides(products))


@query
def conflict_report(products):
    return S.conflict_report(S.resolve_product(*_sides(products)))


@query
def merge_matched(products):
    old = products.where("source = 'shopify' and title is not null and brand is not null").groupBy("title", "brand").agg(F.min_by(F.struct("id", "sku", "category"), "id").alias("r"))
    new = products.where("source <> 'shopify' and title is not null and brand is not null")
    return S.merge_matched(new, old.select("title", "brand", "r.*"), ["title", "brand"])


@query
def deactivate_products(products):
    return S.deactivate_products(products, products.where("price > 1500")).select("id", "status")


@query
def deactivate_offers(offers, products):
    return S.deactivate_offers(offers, products.where("price > 1500")).select("id", "availability", "isInStock")


@query
def ingestion_metrics(syncs, now):
    return M.ingestion_metrics(syncs, now)


@query
def api_metrics_hourly(calls):
    return M.api_metrics_hourly(calls)


@query
def api_metrics_last_hour(calls, now):
    return M.api_metrics_last_hour(M.api_metrics_hourly(calls), now)


@query
def api_slowest(calls, now):
    return M.api_slowest(M.api_metrics_hourly(calls), now)


@query
def cursor_state(syncs):
    return M.cursor_state(syncs)


@query
def sync_status(stores, syncs):
    return M.sync_status(stores, syncs)


@query
def store_metrics(stores, syncs, now):
    return M.store_metrics(stores, syncs, now)


@query
def store_totals(stores, syncs, now):
    return M.store_totals(stores, syncs, now)


@query
def dead_letters(syncs):
    return M.dead_letters(syncs)


@query
def retention(syncs, now):
    return M.retention(syncs, "ts", now, 7).select("event_id", "ts")


@query
def health_rollup(syncs, issues):
    return M.health_rollup(M.dead_letters(syncs), issues)


@query
def issue_summary(issues):
    return M.issue_summary(issues)


@query
def dq_schema(canonical):
    return Q.dq_schema(canonical)


@query
def dq_anomaly(canonical, offers, baseline, now):
    return Q.dq_anomaly(canonical, offers, baseline, now)


@query
def dq_consistency(canonical, products):
    shared = products.withColumn("sku", F.concat(F.lit("S"), F.substring("sku", -2, 2)))
    return Q.dq_consistency(canonical, shared)


@query
def xjoin_sku_conflict(products):
    return Q.xjoin_sku_conflict(products.withColumn("sku", F.concat(F.lit("S"), F.substring("sku", -2, 2))))


@query
def price_change(canonical, baseline):
    return Q.price_change(canonical, baseline).select("canonicalId", F.round("change", 6).alias("change"))


@query
def dq_upsert(issues, canonical, now):
    return Q.dq_upsert(issues, Q.dq_schema(canonical.where("priceMin < 1200")), now)


@query
def dq_run_summary(canonical):
    return Q.dq_run_summary(canonical, Q.dq_schema(canonical))


@query
def dq_incremental(canonical, products):
    return Q.dq_incremental(canonical, products.where("source = 'magento'").select(F.col("canonicalProductId").alias("canonicalId")))


@query
def dq_baseline_update(canonical, baseline):
    return Q.dq_baseline_update(canonical, baseline)


@query
def dq_resolve_manual(issues, now):
    return Q.dq_resolve_manual(issues, issues.where("issueCode = 'MISSING_BRAND'").select("canonicalProductId", "issueCode"), now)


@query
def filter_issues(issues):
    return Q.filter_issues(issues, "warning").select("canonicalProductId", "issueCode")


@query
def validate_products(products):
    return Q.validate_products(products).select("id", F.array_join("errors", ",").alias("errors"))


@query
def ingest_completeness(products, offers):
    return Q.ingest_completeness(products, offers)


@query
def dedup_pairs(products):
    return R.dedup_pairs(products)


@query
def entity_pairs(products):
    return R.entity_pairs(products, cap=None)


@query
def best_match(products):
    return R.best_dedup(products)


@query
def entity_resolve_all(products):
    return R.entity_resolve_all(products)


@query
def resolution_summary(products):
    return R.resolution_summary(R.entity_resolve_all(products))


@query
def canonical_group(products, canonical):
    return R.canonical_group(products, canonical.where("productCount > 1"))


@query
def join_existing_match(products):
    return R.join_existing_match(products.where("source <> 'shopify'"), products.where("source = 'shopify'"))


@query
def filter_products(canonical):
    return flat(V.filter_products(canonical, "ECONOMY", "BRAND#2", "shopify"))


@query
def filter_availability(canonical, offers):
    return flat(V.filter_availability(canonical, offers, False))


@query
def filter_price_containment(canonical):
    return flat(V.filter_price_containment(canonical, 1000, 1400))


@query
def page_products(canonical):
    return flat(V.page(canonical, "price_asc", 2, 20))


@query
def page_search(canonical):
    return flat(V.page(canonical, "price_max_desc", 1, 20))


@query
def product_view(canonical):
    shown = V.product_view(canonical)
    return shown.select("id", "title", F.col("priceRange.min").alias("lo"), F.col("priceRange.max").alias("hi"))


@query
def store_product_counts(stores, products):
    return V.store_product_counts(stores, products)


@query
def semi_store_catalog(canonical, products):
    return flat(V.semi_store_catalog(canonical, products, "store_3"))


@query
def page_store_catalog(canonical, products):
    return flat(V.page(V.semi_store_catalog(canonical, products, "store_3"), "updated_at", 1, 20))


@query
def page_store_offers(offers, canonical):
    return V.page_store_offers(offers, canonical, "store_3")


@query
def page_stores(stores, products):
    return V.page_stores(stores, products)


@query
def page_ai_catalog(canonical):
    return V.ai_catalog_view(V.page(canonical, "updated_at", 1, 50))


@query
def lookup_by_id(canonical, products):
    return flat(V.lookup_by_id(canonical, "canonicalId", products.where("price > 1700").select(F.col("canonicalProductId").alias("canonicalId"))))


@query
def join_product_sources(canonical, products, stores):
    return V.join_product_sources(canonical, products, stores)


@query
def search_suggest(canonical):
    return V.search_suggest(canonical, "ri")


@query
def search_fulltext(documents):
    fields = documents.select(F.col("doc_id").alias("id"), F.substring_index("text", " ", 8).alias("head"), "text")
    return V.search_fulltext(fields, "the that version", {"head": 10, "text": 1})


@query
def ai_product_view(canonical, offers):
    return V.ai_product_view(canonical, offers)


@query
def ai_catalog_view(canonical):
    return V.ai_catalog_view(canonical)


@query
def ai_price_context(canonical, offers, stores):
    return V.ai_price_context(canonical, offers, stores, alone="Available at")


@query
def upsert_replace(products):
    cols = products.select("sourceId", "source", "storeId", "title", "price", "lastSyncedAt")
    new = cols.where("price > 1300").withColumn("price", F.col("price") + 1)
    return U.upsert_replace(cols.where("price < 1500"), new, ["sourceId", "source", "storeId"], "lastSyncedAt")


@query
def upsert_patch(products):
    cols = products.select("id", "title", "price", "status")
    return U.upsert_patch(cols.where("price < 1500"), cols.where("price > 1300").select("id", (F.col("price") + 1).alias("price")), ["id"])


@query
def insert_only(products):
    cols = products.select("id", "title", "price")
    return U.insert_only(cols.where("price < 1500"), cols.where("price > 1300").withColumn("price", F.col("price") + 1), ["id"])


@query
def domain_normalize(pages):
    return G.domain_normalize(pages)


@query
def platform_detect(pages):
    return G.platform_detect(pages)


@query
def html_clean(pages):
    return G.html_clean(pages).select("page_id", F.length("html").alias("n"), F.md5("html").alias("digest"))


@query
def link_extract(pages):
    return G.link_extract(pages)


@query
def store_discover(pages):
    known = pages.where("page_id % 10 = 0").select(G.domain_of(F.col("url")).alias("domain")).distinct()
    return G.store_discover(pages, known)


@query
def extract_jsonld(product_pages):
    return G.extract_jsonld(product_pages)


@query
def extract_opengraph(product_pages):
    return G.extract_opengraph(product_pages)


@query
def extract_cascade(product_pages):
    return G.extract_cascade(product_pages)


@query
def extraction_coverage(product_pages):
    return G.extraction_coverage(G.extract_cascade(product_pages))

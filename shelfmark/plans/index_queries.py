"""Queries over a stored text index, whole conflicts, whole webhook payloads and metrics of a day, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfmark.functions import exprs as X
from shelfmark.operators import metrics as M
from shelfmark.operators import normalize as N
from shelfmark.operators import serve as V
from shelfmark.operators import survive as S
from shelfmark.operators.search_index import SearchIndex, search_page
from shelfmark.plans import views
from shelfmark.plans.oracle import PRIORITY, C
from shelfmark.plans.queries import canonical
from shelfmark.plans.views_sql import sql, text_normalize
from shelfmark.sources.shared import shared_folder

QUERIES, SQL = {}, {}
SEARCHED = {"title": 10, "brand": 5, "description": 1}
SAID = "red bolt, Brand 7"


def query(text: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, text
        return f

    return add


def indexed(spark, sf, changed: bool = False) -> SearchIndex:
    """An index of the canonical products, or one with changes: cheap products renamed, dear ones removed, then some back."""
    index = SearchIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", SEARCHED)
    rows = canonical(spark, sf)
    index.build(rows, "canonicalId")
    if changed:
        renamed = rows.where("priceMin < 1500").withColumn("title", F.lit("Blue bolt bolt"))
        index.change(renamed, rows.where("priceMin >= 2000"), "canonicalId")
        index.change(rows.where("priceMin >= 2500").withColumn("title", F.lit("red")), rows.limit(0), "canonicalId")
    return index


def scored(rows: str) -> dict[str, str]:
    """Scores of the rows, counted over their whole texts."""
    said = "['red', 'bolt', 'brand', '7']"
    words = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda w: w <> '')"
    part = lambda f, w: f"coalesce({w}::DOUBLE * len(list_filter({words.format(f)}, lambda w: list_contains({said}, w))) / nullif(sqrt(len({words.format(f)})), 0), 0)"
    total = " + ".join(part(f, w) for f, w in SEARCHED.items())
    return {"scored": f"""SELECT *, round({total}, 6) AS score FROM ({rows})""", "found": "SELECT * FROM scored WHERE score > 0"}


@query(sql('SELECT "canonicalId" AS key, score FROM found', **C, **scored("FROM canonical")))
def search_index(spark, sf):
    """All matches of a search by a stored index, which reads the buckets of its words only."""
    return indexed(spark, sf).search(SAID)


CHANGED = """SELECT * REPLACE (CASE WHEN "priceMin" < 1500 THEN 'Blue bolt bolt' WHEN "priceMin" >= 2500 THEN 'red' ELSE title END AS title)
    FROM canonical WHERE "priceMin" < 2000 OR "priceMin" >= 2500"""


@query(sql('SELECT "canonicalId" AS key, score FROM found', **C, **scored(CHANGED)))
def search_index_changed(spark, sf):
    """The same search after two changes of the index."""
    return indexed(spark, sf, changed=True).search(SAID)


@query(sql('SELECT "canonicalId", title, round(score, 2) AS score FROM found ORDER BY found.score DESC, "canonicalId" LIMIT 20 OFFSET 20', **C, **scored("""FROM canonical
    WHERE "priceMin" >= 1000 AND "priceMax" <= 3000 AND EXISTS (FROM v_offers o WHERE o."canonicalProductId" = "canonicalId" AND o."isInStock")""")))
def search_index_page(spark, sf):
    """The second page by relevance, of products in a price range with an offer in stock."""
    kept = V.filter_availability(V.filter_price_containment(canonical(spark, sf), 1000, 3000), views.offers(spark, sf), True)
    return search_page(indexed(spark, sf).search(SAID), kept, "relevance", 2, 20).select("canonicalId", "title", "score")


# Conflicts. A third of the rows has no time, the others that of their month, so that all rules decide somewhere.
def sides(spark, sf):
    """The first product of each title and the others with that title, with attributes and images of both sides."""
    key = F.col("sourceId").cast("long")
    p = views.products(spark, sf).where("title is not null").withColumns({
        "canonicalProductId": F.concat_ws("|", "title", F.col("currency")), "cleanedTitle": X.text_normalize(F.col("title")), "normalizedBrand": X.brand_normalize(F.col("brand")),
        "lastSyncedAt": F.when(key % 3 != 0, F.date_trunc("month", "lastSyncedAt")), "size": F.col("attributes")["size"],
    })
    first = p.groupBy("canonicalProductId").agg(F.min("id").alias("first"))
    joined = p.join(first, "canonicalProductId")
    old = joined.where("id = first").withColumn("attributes", F.create_map(F.lit("size"), F.col("size"), F.lit("type"), F.col("category")))
    new = joined.where("id <> first").withColumn("attributes", F.create_map(F.lit("size"), F.col("size"), F.lit("maker"), F.col("brand")))
    return old, new.withColumn("images", F.concat(F.array(F.lit("  "), F.concat(F.lit(" https://img.example.com/"), F.col("size"), F.lit(".jpg"))), "images"))


FILLED = "coalesce(trim({}), '') <> ''"
WHOLE = {
    "p": f"""SELECT *, title || '|' || currency AS c, {text_normalize("title")} AS "cleanedTitle", nullif(trim(lower(brand)), '') AS "normalizedBrand",
        CASE WHEN p_partkey % 3 <> 0 THEN date_trunc('month', "lastSyncedAt") END AS t, {PRIORITY} AS pr, 'https://img.example.com/' || p_partkey || '.jpg' AS image
        FROM v_raw_products WHERE title IS NOT NULL""",
    "sided": "SELECT *, id = min(id) OVER (PARTITION BY c) AS is_old FROM p",
    "paired": "SELECT o AS o, n AS n FROM sided o JOIN sided n ON o.c = n.c AND o.is_old AND NOT n.is_old",
    "told": " UNION ALL ".join(
        f"""SELECT o.c AS "canonicalProductId", n.id AS "productId", '{name}' AS field, {e} AS e, {i} AS i, o.pr AS pe, n.pr AS pi, o.t AS te, n.t AS ti FROM paired"""
        for name, e, i in [(f, f'o."{f}"', f'n."{f}"') for f in S.WHOLE_FIELDS] + [("attributes.size", "o.size", "n.size"), ("attributes.maker", "NULL", "n.brand")]
    ),
    "judged": f"""SELECT *, CASE WHEN NOT {FILLED.format("e")} THEN 'incoming null_fallback' WHEN NOT {FILLED.format("i")} THEN 'existing null_fallback'
        WHEN pe <> pi THEN CASE WHEN pe < pi THEN 'existing' ELSE 'incoming' END || ' source_priority'
        WHEN te IS DISTINCT FROM ti THEN CASE WHEN ti IS NULL OR te > ti THEN 'existing' ELSE 'incoming' END || ' recency'
        WHEN length(i) > length(e) THEN 'incoming completeness' ELSE 'existing completeness' END AS w FROM told""",
}


@query(sql("""SELECT "canonicalProductId", "productId", field, split_part(w, ' ', 1) AS winner, split_part(w, ' ', 2) AS reason FROM judged WHERE e IS DISTINCT FROM i""", **WHOLE))
def resolve_whole(spark, sf):
    """Conflicts in six fields and in attributes."""
    found = S.resolve_whole(*sides(spark, sf)).select("canonicalProductId", "productId", F.inline("conflicts"))
    return found.select("canonicalProductId", "productId", "field", "winner", "reason")


VALUE = "max(CASE WHEN w LIKE 'incoming%' THEN i ELSE e END) FILTER (field = '{}')"
IMAGES = """list_filter([CASE WHEN o.has_image THEN o.image END, 'https://img.example.com/' || n.size || '.jpg',
    CASE WHEN n.has_image THEN n.image END], lambda u: u IS NOT NULL)"""


@query(sql(f"""SELECT "canonicalProductId", "productId", {", ".join(f'{VALUE.format(f)} AS "{f}"' for f in S.WHOLE_FIELDS)}, {VALUE.format("attributes.size")} AS size,
    {VALUE.format("attributes.maker")} AS maker, any_value(b.kind) AS kind, any_value(b.images) AS images FROM judged JOIN pictures b ON b.id = "productId" GROUP BY ALL""",
    **WHOLE, pictured=f"SELECT n.id AS id, o.category AS kind, {IMAGES} AS l FROM paired",
    pictures="SELECT id, kind, array_to_string(list_filter(l, lambda u, n: list_position(l, u) = n), ' ') AS images FROM pictured"))
def resolved_whole(spark, sf):
    """Each incoming product resolved against the first of its title: fields, attributes and images."""
    a = F.col("attributes")
    return S.resolve_whole(*sides(spark, sf)).select(
        "canonicalProductId", "productId", *S.WHOLE_FIELDS, a["size"].alias("size"), a["maker"].alias("maker"), a["type"].alias("kind"), F.array_join("images", " ").alias("images"),
    )


@query(sql("""SELECT s.id AS "storeId", "lastStatus", "lastSync", coalesce(syncs, 0) AS syncs, coalesce(products, 0) AS products,
    coalesce("lastStatus" <> 'success', false) AS failing, coalesce("lastSync" >= n.t - INTERVAL 24 HOUR, false) AS synced FROM v_stores s CROSS JOIN v_now n LEFT JOIN
    (SELECT "storeId", arg_max(status, ROW(ts, event_id)) AS "lastStatus", max(ts) AS "lastSync", count(*) FILTER (ts >= t - INTERVAL 24 HOUR) AS syncs,
    CAST(sum("successProducts") FILTER (ts >= t - INTERVAL 24 HOUR) AS BIGINT) AS products FROM v_sync_metrics, v_now GROUP BY ALL) m ON m."storeId" = s.id"""))
def store_metrics_day(spark, sf):
    return M.store_metrics_day(views.stores(spark, sf), views.sync_metrics(spark, sf), views.as_of(spark, sf))


def rest_payloads(spark, sf):
    """Products as REST payloads: ids with and without a scheme, tags as list and text, blank, missing and broken values."""
    p = views.products(spark, sf).withColumn("k", F.col("sourceId").cast("long"))
    currency = F.array(F.struct(F.struct(F.lit("1").alias("amount"), F.col("currency").alias("currency_code")).alias("price")))
    one = F.struct(
        F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise(F.concat(F.lit("gid://shopify/ProductVariant/"), "sourceId")).alias("id"), F.coalesce("sku", F.lit("")).alias("sku"),
        F.round("price").cast("long").alias("price"), F.when(F.col("k") % 5 == 0, F.lit("99.50")).alias("compare_at_price"), (F.col("k") % 9).alias("inventory_quantity"),
        F.when(F.col("k") % 3 == 0, F.col("k")).alias("inventory_item_id"), F.when(F.col("k") % 4 != 0, currency).alias("presentment_prices"),
    )
    images = F.transform("images", lambda u: F.struct(u.alias("src"), F.lit(1).alias("position")))
    body = lambda tags: F.to_json(F.struct(
        "k", F.col("k").alias("id"), "title", F.col("description").alias("body_html"), F.coalesce("brand", F.lit("")).alias("vendor"), F.col("category").alias("product_type"), "status",
        tags.alias("tags"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), images.alias("images"), F.when(F.col("k") % 7 != 0, F.array(one)).alias("variants"),
    ))
    text = F.when(F.col("k") % 13 == 0, "{broken").when(F.col("k") % 2 == 0, body(F.array(F.lit("a, b"), F.lit("c")))).otherwise(body(F.lit("a, b ,")))
    return p.select(F.col("id").alias("eventId"), text.alias("payload"))


@query(sql("""SELECT id AS "eventId", CASE WHEN ok THEN 'gid://shopify/Product/' || p_partkey END AS id, CASE WHEN ok THEN coalesce(title, '') ELSE '' END AS title,
    CASE WHEN ok THEN description END AS description, CASE WHEN ok THEN brand END AS vendor, CASE WHEN ok THEN category END AS "productType", CASE WHEN ok THEN status END AS status,
    CASE WHEN NOT ok THEN '' WHEN p_partkey % 2 = 0 THEN 'a, b|c' ELSE 'a|b' END AS tags, CASE WHEN ok THEN '2024-01-01T00:00:00Z' END AS "createdAt", CAST(NULL AS VARCHAR) AS "updatedAt",
    CASE WHEN ok AND has_image THEN 'https://img.example.com/' || p_partkey || '.jpg' ELSE '' END AS images, CASE WHEN sold AND p_partkey % 4 <> 0 THEN currency ELSE 'INR' END AS "currencyCode",
    CASE WHEN sold THEN 'gid://shopify/ProductVariant/' || p_partkey END AS variant, CASE WHEN sold THEN sku END AS sku, CASE WHEN sold THEN CAST(CAST(round(price) AS BIGINT) AS VARCHAR) END AS price,
    CASE WHEN sold AND p_partkey % 5 = 0 THEN '99.50' END AS "compareAtPrice", CASE WHEN sold THEN p_partkey % 9 END AS quantity,
    CASE WHEN sold AND p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) END AS item FROM (SELECT *, p_partkey % 13 <> 0 AS ok, p_partkey % 13 <> 0 AND p_partkey % 7 <> 0 AS sold FROM v_raw_products)"""))
def norm_webhook_payload(spark, sf):
    """Whole REST payloads, with the first variant as columns."""
    v = F.get("variants", F.lit(0))
    return N.norm_webhook_payload(rest_payloads(spark, sf)).select(
        "eventId", "id", "title", "description", "vendor", "productType", "status", F.array_join("tags", "|").alias("tags"), "createdAt", "updatedAt",
        F.array_join("images", "|").alias("images"), "currencyCode", v["id"].alias("variant"), v["sku"].alias("sku"), v["price"].alias("price"),
        v["compareAtPrice"].alias("compareAtPrice"), v["inventoryQuantity"].alias("quantity"), v["inventoryItemId"].alias("item"),
    )


def inventory(spark, sf):
    """Offers, and patches of the events' users as SKUs: a third without a store, some for another one, fields left out."""
    e = views.webhooks(spark, sf).where("topic = 'inventory'")
    quantity = F.when(F.col("event_id") % 4 != 0, F.floor(F.col("value") % 40).cast("long"))
    return views.offers(spark, sf), e.select(
        F.concat(F.lit("SKU-"), F.col("user_id").cast("string")).alias("sku"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("store_"), (F.col("event_id") % 20).cast("string"))).alias("storeId"),
        F.col("event_id").alias("seq"), quantity.alias("stockQty"), (quantity > 0).alias("isInStock"), quantity.alias("availableInventory"),
        F.when(F.col("event_id") % 5 == 0, F.lit("F1")).alias("facilityCode"), F.col("ts").alias("lastSyncedAt"),
    )


SETS = {
    "patches": """SELECT 'SKU-' || user_id AS sku, CASE WHEN event_id % 3 <> 0 THEN 'store_' || (event_id % 20) END AS "storeId", event_id AS seq,
        CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value % 40) AS BIGINT) END AS q, CASE WHEN event_id % 5 = 0 THEN 'F1' END AS f, ts FROM v_webhooks WHERE topic = 'inventory'""",
    "fitting": """SELECT o.id, arg_max(p.q, seq) FILTER (p.q IS NOT NULL) AS q, arg_max(f, seq) FILTER (f IS NOT NULL) AS f, arg_max(ts, seq) AS ts
        FROM v_offers o JOIN patches p ON p.sku = o.sku AND (p."storeId" IS NULL OR p."storeId" = o."storeId") GROUP BY o.id""",
}


@query(sql("""SELECT o.id, coalesce(q, "stockQty") AS "stockQty", coalesce(q > 0, "isInStock") AS "isInStock", q AS "availableInventory", f AS "facilityCode",
    coalesce(ts, "lastSyncedAt") AS "lastSyncedAt", p.id IS NOT NULL AS matched,
    p.id IS NOT NULL AND (q IS NOT NULL OR f IS NOT NULL OR ts <> "lastSyncedAt") AS modified FROM v_offers o LEFT JOIN fitting p USING (id)""", **SETS))
def patch_inventory(spark, sf):
    """Offers after all patches of their SKU and store."""
    fields = ("stockQty", "isInStock", "availableInventory", "facilityCode", "lastSyncedAt")
    return N.patch_inventory(*inventory(spark, sf)).select("id", *fields, "matched", "modified")


@query(sql("""SELECT seq, sku, "storeId", (SELECT count(*) FROM v_offers o WHERE o.sku = p.sku AND (p."storeId" IS NULL OR o."storeId" = p."storeId")) AS "offersMatched",
    (SELECT count(*) FROM v_raw_products r WHERE r.sku = p.sku AND (p."storeId" IS NULL OR r."storeId" = p."storeId")) AS "productsMatched" FROM patches p""", **SETS))
def inventory_matches(spark, sf):
    offers, patches = inventory(spark, sf)
    variants = views.products(spark, sf).select(F.col("id").alias("productId"), "storeId", "sku")
    return N.inventory_matches(patches, offers, variants, views.offer_parts(spark, sf))

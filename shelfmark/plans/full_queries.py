"""Queries for the uncapped, uncut and fuller forms of operators, each with its SQL beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfmark.functions import exprs as X
from shelfmark.operators import normalize as N
from shelfmark.operators import pages as G
from shelfmark.operators import quality as Q
from shelfmark.operators import resolve as R
from shelfmark.operators import serve as V
from shelfmark.operators import survive as S
from shelfmark.operators import upsert as U
from shelfmark.plans import views
from shelfmark.plans.catalog_queries import category_rows
from shelfmark.plans.oracle import CLEAN_HTML, CONFLICT, ENTITY, FLAT, KEYED, NEAR, RESOLVED, C, schema_issues
from shelfmark.plans.queries import canonical, flat, pick
from shelfmark.plans.views_sql import sql
from shelfmark.sources import platforms as P
from shelfmark.sources.shared import shared_folder
from shelfmark.sources.tables import table
from shelfmark.streaming import events as E
from shelfmark.streaming.queries import drained, webhook_stream

QUERIES, SQL = {}, {}


def query(text: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, text
        return f

    return add


# Resolution without caps. Titles get a word of their own, so that some have three.
WORDED = {
    "v_worded": """SELECT * REPLACE (title || ' s' || size AS title) FROM v_products""",
    "features": ENTITY["features"].replace("v_products", "v_worded"),
    "near": NEAR,
}
SCORED = {"common": ENTITY["common"], "names": ENTITY["names"], "titles": ENTITY["titles"], "based": ENTITY["based"], "scored": ENTITY["scored"], "matched": ENTITY["matched"]}
DEDUP_ALL = WORDED | {
    "pairs": "SELECT * FROM near WHERE CASE WHEN ca <> '' THEN ca = cb ELSE ba = bb END",
    "common": ENTITY["common"], "names": ENTITY["names"], "titles": ENTITY["titles"],
    "scored": """SELECT id, match, round(coalesce(title, 0) * 0.4::DOUBLE + brand * 0.2::DOUBLE + (1 - abs(pa - pb) / greatest(pa, pb)) * 0.3::DOUBLE + category * 0.1::DOUBLE, 6) AS score
        FROM pairs LEFT JOIN titles USING (na, nb)""",
    "matched": "SELECT * FROM scored WHERE score >= 0.8",
}
ENTITY_ALL = WORDED | {"pairs": KEYED} | SCORED
BEST = {"best": "SELECT id, arg_min(match, ROW(-score, match)) AS match, max(score) AS score FROM matched GROUP BY id"}


def worded(spark, sf):
    return views.products(spark, sf).withColumn("title", F.concat("title", F.lit(" s"), F.col("attributes")["size"]))


@query(sql("SELECT * FROM matched", **DEDUP_ALL))
def dedup_pairs_all(spark, sf):
    return R.dedup_pairs(worded(spark, sf), cap=None)


@query(sql("SELECT * FROM matched", **ENTITY_ALL))
def entity_pairs_all(spark, sf):
    return R.entity_pairs(worded(spark, sf), cap=None)


@query(sql("SELECT * FROM best", **DEDUP_ALL, **BEST))
def best_match_all(spark, sf):
    """The best of all matches, not only of those among a block's first rows."""
    return R.best_dedup(worded(spark, sf), cap=None)


@query(sql("SELECT * FROM resolved", **ENTITY_ALL, **BEST, resolved=RESOLVED))
def entity_resolve_exact(spark, sf):
    return R.entity_resolve_all(worded(spark, sf), cap=None)


@query(sql("""SELECT count(*) AS total, count(*) FILTER (state = 'resolved') AS resolved, count(*) FILTER (state = 'unresolved') AS unresolved,
    count(*) FILTER (state = 'skipped') AS skipped, round(count(*) FILTER (state = 'resolved') / (count(*) - count(*) FILTER (state = 'skipped')), 6) AS rate FROM states""",
    **ENTITY_ALL, **BEST, states=RESOLVED))
def resolution_summary_all(spark, sf):
    return R.resolution_summary(R.entity_resolve_all(worded(spark, sf), cap=None))


@query(sql("""SELECT count(*) AS resolved, round(avg(score), 6) AS "meanConfidence" FROM best""", **ENTITY_ALL, **BEST))
def mean_confidence(spark, sf):
    return R.mean_confidence(R.entity_resolve_all(worded(spark, sf), cap=None).withColumn("state", F.when(F.col("match").isNotNull(), "resolved")))


@query(sql("""SELECT p.id, c AS "canonicalId", CASE WHEN c IS NULL THEN match END AS match, CASE WHEN c IS NOT NULL THEN 1.0 ELSE score END AS confidence,
    CASE WHEN c IS NOT NULL THEN 'canonical' WHEN match IS NOT NULL THEN 'scored' ELSE 'none' END AS "matchKind"
    FROM (SELECT id, CASE WHEN p_partkey % 2 = 0 THEN "canonicalProductId" END AS c FROM v_worded) p LEFT JOIN best USING (id)""", **ENTITY_ALL, **BEST))  # fmt: skip
def resolve_incoming(spark, sf):
    known = F.when(F.col("sourceId").cast("long") % 2 == 0, F.col("canonicalProductId"))
    return R.resolve_incoming(worded(spark, sf).withColumn("canonicalProductId", known), worded(spark, sf))


EVALUATED = {
    "features": ENTITY["features"],
    "labels": """SELECT min(id) AS a, max(id) AS b, true AS expected FROM v_products WHERE brand IS NOT NULL AND title IS NOT NULL GROUP BY brand, title HAVING min(id) <> max(id)
        UNION ALL SELECT id, 'prod_' || (p_partkey + 1), false FROM v_products WHERE brand IS NOT NULL AND title IS NOT NULL AND p_partkey % 3 = 0""",
    "pairs": """SELECT expected, a.id AS id, b.id AS match, a.price AS pa, b.price AS pb, a.sku AS sa, b.sku AS sb, a.size AS za, b.size AS zb, a.name AS na, b.name AS nb,
        CASE WHEN a.b IS NULL AND b.b IS NULL THEN 0.5::DOUBLE WHEN a.b = b.b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS brand,
        CASE WHEN a.cat = '' OR b.cat = '' THEN 0.5::DOUBLE WHEN a.cat = b.cat THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS category
        FROM labels l JOIN features a ON a.id = l.a JOIN features b ON b.id = l.b""",
    "common": ENTITY["common"], "names": ENTITY["names"], "titles": ENTITY["titles"], "based": ENTITY["based"],
    "judged": """SELECT expected, CASE WHEN abs(pa - pb) / greatest(pa, pb) > 0.30 THEN false WHEN sa IS NOT NULL AND sb IS NOT NULL AND sa = sb THEN true
        WHEN sa IS NOT NULL AND sb IS NOT NULL THEN false ELSE round(least(1.0::DOUBLE, base), 6) >= 0.8 END AS predicted FROM based""",
}


SQL["accuracy_eval"] = sql("""SELECT count(*) AS pairs, count(*) FILTER (predicted AND NOT expected) AS "falsePositives", count(*) FILTER (NOT predicted AND expected) AS "falseNegatives",
    round(avg(CASE WHEN predicted = expected THEN 1 ELSE 0 END), 6) AS accuracy FROM judged""", **EVALUATED)  # fmt: skip


# Rules, filters and views with arguments that find rows.


def broken(spark, sf):
    """Products of which each breaks one rule, by its key."""
    p, k = views.products(spark, sf), F.col("sourceId").cast("long")
    one = lambda n, c, value: F.when(k % 23 == n, value).otherwise(F.col(c)).alias(c)
    none = lambda c: F.lit(None).cast(c)
    variant = F.struct(
        F.when(k % 23 == 13, F.lit(" ")).otherwise("v1").alias("variantId"), F.when(k % 23 == 14, none("double")).when(k % 23 == 15, F.lit(-1.0)).otherwise(F.lit(5.0)).alias("price"),
        F.when(k % 23 == 16, "usd").otherwise("USD").alias("currency"),
    )
    return p.select(
        F.col("id").alias("key"), one(1, "id", F.lit("")), one(2, "sourceId", none("string")), one(3, "title", F.repeat(F.lit("t"), F.lit(501))), one(4, "source", F.lit("ebay")),
        one(5, "status", F.lit("gone")), one(6, "price", F.lit(-0.5)), one(7, "currency", F.lit("Rs")), one(8, "storeId", F.lit(" ")), one(9, "lastSyncedAt", none("timestamp")),
        one(10, "description", F.repeat(F.lit("d"), F.lit(10_001))), one(11, "images", F.array(F.lit("ftp://x"))), F.when(k % 23 != 12, F.array(variant)).alias("variants"),
        one(17, "brand", F.repeat(F.lit("b"), F.lit(201))), one(18, "category", F.repeat(F.lit("c"), F.lit(201))),
    )


BROKEN = {1: "required:id", 2: "required:sourceId", 4: "enum:source", 5: "enum:status", 6: "minimum:price", 7: "pattern:currency", 8: "required:storeId", 9: "required:lastSyncedAt",
    10: "maxLength:description", 11: "format:images", 12: "minItems:variants", 13: "required:variantId", 14: "required:variantPrice", 15: "minimum:variantPrice",
    16: "pattern:variantCurrency", 17: "maxLength:brand", 18: "maxLength:category"}


@query(sql("""SELECT id AS key, unnest(list_filter([CASE WHEN title IS NULL AND p_partkey % 23 <> 3 THEN 'required:title' WHEN p_partkey % 23 = 3 THEN 'maxLength:title' END, CASE p_partkey % 23 """
    + " ".join(f"WHEN {n} THEN '{rule}'" for n, rule in BROKEN.items()) + " END], lambda e: e IS NOT NULL)) AS error FROM v_products"))
def validate_broken_products(spark, sf):
    return Q.validate_products(broken(spark, sf)).select("key", F.explode("errors").alias("error"))


@query(sql(FLAT + " WHERE category = 'ECONOMY' AND lower(brand) = (SELECT lower(min(brand)) FROM canonical WHERE category = 'ECONOMY') AND strpos(sources, 'shopify') > 0", **C))
def filter_products_found(spark, sf):
    rows = canonical(spark, sf)
    brand = rows.where("category = 'ECONOMY'").agg(F.min("brand")).first()[0]
    return flat(V.filter_products(rows, "ECONOMY", (brand or "").upper(), "shopify"))


@query("""WITH d AS (SELECT page_id, url, regexp_extract(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', ''), '([^.]+\\.[^.]+)$', 1) || (page_id % 3) AS domain FROM pages)
    SELECT domain, count(*) AS pages, 'store_' || substr(sha256(domain), 1, 16) AS id FROM d WHERE page_id % 3 <> 0 GROUP BY domain""")  # fmt: skip
def store_discover_found(spark, sf):
    """New stores of domains that differ by the page's number, a third of which is known."""
    pages = table(spark, sf, "pages").select(F.regexp_replace("url", r"^([a-zA-Z]+://[^/?#:]+).*$", "$1").alias("host"), (F.col("page_id") % 3).cast("string").alias("n"))
    named = pages.select(F.concat("host", "n", F.lit("/x")).alias("url"), "n")
    known = named.where("n = '0'").select(G.domain_of(F.col("url")).alias("domain")).distinct()
    return G.store_discover(named.select("url"), known)


@query(sql("SELECT * FROM found", **C, touched="""SELECT * FROM canonical WHERE "canonicalId" IN (SELECT "canonicalProductId" FROM v_products WHERE p_partkey % 2 = 0)""", found=schema_issues("touched")))
def dq_incremental_found(spark, sf):
    touched = views.products(spark, sf).where("cast(sourceId as long) % 2 = 0").select(F.col("canonicalProductId").alias("canonicalId"))
    return Q.dq_incremental(canonical(spark, sf), touched).select("canonicalProductId", "issueCode", "severity")


@query(sql("""SELECT count(*) AS total, CAST(2 AS INTEGER) AS page, CAST(20 AS INTEGER) AS "limit", count(*) > 40 AS "hasMore" FROM canonical""", **C))
def page_totals(spark, sf):
    return V.page_totals(canonical(spark, sf), 2, 20)


@query(sql(FLAT + """ WHERE strpos(lower(concat_ws(' ', title, brand, description)), 'ring') > 0 AND strpos(lower(concat_ws(' ', title, brand, description)), 'brand') > 0
    AND "priceMax" >= 1000 AND "priceMin" <= 1500""", **C))  # fmt: skip
def search_catalog(spark, sf):
    return flat(V.search_catalog(canonical(spark, sf), "Ring Brand", low=1000, high=1500))


@query(sql("""SELECT id, '{"a":{"Api-Key":"[REDACTED]","n":[{"password":"[REDACTED]"},1]},"name":"' || name || '"}' AS payload FROM v_stores"""))
def redact_nested(spark, sf):
    text = F.concat(F.lit('{"a": {"Api-Key": {"x": 1}, "n": [{"password": "p"}, 1]}, "name": "'), "name", F.lit('"}'))
    return V.redact_json(views.stores(spark, sf).select("id", text.alias("payload")), "payload")


# Merging with variants, attributes and images.

VARIANTS = {"v_varied": """SELECT *, 'v' || (p_partkey % 3) AS v, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'c' || (p_partkey % 5) END AS colour FROM v_products WHERE "canonicalProductId" IS NOT NULL"""}


def varied(spark, sf):
    k = F.col("sourceId").cast("long")
    none = F.lit(None).cast("string")
    one = F.struct(
        F.concat(F.lit("v"), (k % 3).cast("string")).alias("variantId"), none.alias("sku"), F.concat(F.lit("Size "), (k % 4).cast("string")).alias("title"), F.col("price"), "currency",
        F.array(F.struct(F.lit("Colour").alias("name"), F.concat(F.lit("c-"), (k % 2).cast("string")).alias("value"))).alias("options"), F.create_map(F.lit("fit"), F.lit("<b>Slim</b>")).alias("attributes"),
    )
    colour = F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("c"), (k % 5).cast("string")))
    return views.products(spark, sf).withColumn("variants", F.array(one)).withColumn("attributes", F.map_concat("attributes", F.create_map(F.lit("colour"), colour)))


@query(sql("""SELECT "canonicalProductId" AS "canonicalId", CAST(row_number() OVER (PARTITION BY "canonicalProductId" ORDER BY t, id) - 1 AS INTEGER) AS position, v AS "variantId", price
    FROM (SELECT "canonicalProductId", v, min("lastSyncedAt") AS t, arg_min(id, ROW("lastSyncedAt", id)) AS id, arg_min(price, ROW("lastSyncedAt", id)) AS price FROM v_varied GROUP BY ALL)""", **VARIANTS))  # fmt: skip
def merged_variants(spark, sf):
    return S.merged_variants(varied(spark, sf)).select("canonicalId", F.posexplode("variants").alias("position", "v")).select("canonicalId", "position", "v.variantId", "v.price")


def _attributes(order: str, filled: str) -> str:
    return f"""WITH_ SELECT "canonicalProductId" AS "canonicalId", key, arg_min(value, {order}) AS value FROM (
        SELECT *, 'size' AS key, size AS value FROM v_varied UNION ALL SELECT *, 'colour', colour FROM v_varied) {filled} GROUP BY ALL""".removeprefix("WITH_ ")


PRIORITY = CONFLICT["ranked_products"].split("SELECT *, ")[1].split(" AS pr")[0]


@query(sql(_attributes("""ROW(value = '', "lastSyncedAt", id)""", ""), **VARIANTS))
def merged_attributes(spark, sf):
    return S.merged_attributes(varied(spark, sf))


@query(sql(_attributes(f"""ROW({PRIORITY}, -epoch_us("lastSyncedAt"), -length(value), id)""", "WHERE value <> ''"), **VARIANTS))
def golden_attributes(spark, sf):
    return S.golden_attributes(varied(spark, sf))


@query(sql(f"""SELECT "canonicalProductId" AS "canonicalId", CAST(row_number() OVER (PARTITION BY "canonicalProductId" ORDER BY {PRIORITY}, id) - 1 AS INTEGER) AS position,
    'https://img.example.com/' || p_partkey || '.jpg' AS url FROM v_products WHERE "canonicalProductId" IS NOT NULL AND has_image"""))  # fmt: skip
def golden_images(spark, sf):
    return S.golden_images(views.products(spark, sf))


@query(sql("""SELECT id, CASE WHEN p_partkey % 4 = 0 THEN 'sku_' || p_partkey WHEN title IS NOT NULL AND brand IS NOT NULL THEN
    regexp_replace(lower(brand), '[^a-z0-9]+', '_', 'g') || '_' || regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g') || '_c_' || (p_partkey % 2) || '_colour_size_' || (p_partkey % 4) || '_slim' END AS key,
    price AS low, currency FROM v_products"""))  # fmt: skip
def grouping_keys(spark, sf):
    """Grouping keys with the signature of the variants, and the price range of these."""
    rows = varied(spark, sf)
    plain = lambda c: F.regexp_replace(X.blank_to_null(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ", "_")
    named = F.concat_ws("_", plain("brand"), plain("title"), X.variant_signature(F.col("variants")))
    key = F.coalesce(plain("sku"), F.when(plain("brand").isNotNull() & plain("title").isNotNull(), named))
    spread = X.price_range(F.col("variants"))
    return rows.select("id", key.alias("key"), spread["min"].alias("low"), spread["currency"].alias("currency"))


@query(sql("""SELECT id, CASE WHEN price < 50000 THEN round((50000 - price) / 50000 * 100) END AS discount, CASE WHEN "stockQty" <> 0 THEN price / "stockQty" END AS "perUnit" FROM v_offers"""))
def offer_discounts(spark, sf):
    """What offers are below 50,000, in percent, and their price by the quantity."""
    return views.offers(spark, sf).select("id", X.discount_percent(F.lit(50000.0), F.col("price")).alias("discount"), X.price_per_unit(F.col("price"), F.col("stockQty").cast("double")).alias("perUnit"))


@query(sql("""SELECT "storeId", count(*) AS "orphanOffers" FROM v_offers WHERE l_key % 7 = 0 GROUP BY ALL""".replace("l_key", """CAST(substr("productId", 6) AS BIGINT)""")))
def orphan_offers(spark, sf):
    return Q.orphan_offers(views.products(spark, sf).where("cast(sourceId as long) % 7 <> 0"), views.offers(spark, sf))


# Keyed tables.


@query(sql("""SELECT 'shopify' AS platform, CAST(user_id AS VARCHAR) AS "sourceId", arg_max(event_id, ROW(ts, event_id)) AS last FROM events GROUP BY user_id"""))
def raw_archive_last(spark, sf):
    """The last payload of each user by time, which isn't the greatest text."""
    came = table(spark, sf, "events").select(
        F.lit("shopify").alias("platform"), F.format_string('{"id": "%d", "n": %d}', "user_id", "event_id").alias("payload"), F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id").alias("at")
    )
    empty = spark.createDataFrame([], "platform string, sourceId string, payload string")
    return U.raw_archive(empty, came, "at").select("platform", "sourceId", F.get_json_object("payload", "$.n").cast("long").alias("last"))


@query(sql("""SELECT id, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'new' ELSE brand END AS brand, CASE WHEN p_partkey % 3 = 1 THEN category ELSE category END AS category FROM v_products"""))
def upsert_given(spark, sf):
    """Brands set to null, set anew, or not given."""
    rows, k = views.products(spark, sf).select("id", "brand", "category"), F.substring("id", 6, 20).cast("long")
    patch = rows.select("id", F.when(k % 3 == 1, "new").alias("brand"), F.lit("lost").alias("category"), F.when(k % 3 < 2, F.array(F.lit("brand"))).otherwise(F.array().cast("array<string>")).alias("given"))
    return U.upsert_given(rows, patch, ["id"], "given")


@query(sql('SELECT DISTINCT "webhookId", topic, CAST(1 AS BIGINT) AS n FROM v_webhooks'))
def stream_dedup_rows(spark, sf):
    """How many rows of each webhook the stream lets through."""
    stream = webhook_stream(spark, sf).withColumns({"platform": F.lit("shopify"), "storeId": F.lit("s1")})
    return drained(E.stream_dedup(stream, E.STORE_KEYS), "append").groupBy("webhookId", "topic").agg(F.count("*").alias("n"))


# Pages.


@query("""SELECT 'https://shop.example.com/products/' || page_id AS url FROM pages WHERE page_id % 4 = 0 AND page_id % 3 <> 2""")
def scan_product_sitemaps(spark, sf):
    """Product URLs of XML and plain sitemaps that an index names; others are not followed."""
    k = F.col("page_id")
    base = F.concat(F.lit("https://shop.example.com/"), pick(k, "products/", "blog/products/", "about/", "collections/"), k.cast("string"))
    each = table(spark, sf, "pages").select((k % 3).alias("file"), base.alias("url"))
    texts = each.groupBy("file").agg(F.sort_array(F.collect_list("url")).alias("urls"))
    xml = F.concat(F.lit("<?xml version='1.0'?>\n<urlset>"), F.array_join(F.transform("urls", lambda u: F.concat(F.lit("<url>\n <loc> "), u, F.lit(" </loc><lastmod>x</lastmod></url>"))), ""), F.lit("</urlset>"))
    path = f"{shared_folder(spark)}/sitemaps-{uuid.uuid4().hex}"
    for n in range(3):
        texts.where(F.col("file") == n).select((F.array_join("urls", "\n") if n == 1 else xml).alias("value")).coalesce(1).write.text(f"{path}/part{n}")
    kept = [row.name for n in (0, 1) for row in spark.read.text(f"{path}/part{n}").select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("name")).distinct().collect()]
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://shop.example.com/{name}</loc></sitemap>" for name in kept) + "</sitemapindex>"
    spark.range(1).select(F.lit(index).alias("value")).coalesce(1).write.text(f"{path}/index")
    start = [row.name for row in spark.read.text(f"{path}/index").select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("name")).distinct().collect()]
    return P.scan_product_sitemaps(spark, f"{path}/*", start)


@query("""SELECT 'https://shop.example.com/products/' || page_id AS url FROM pages WHERE page_id % 6 < 3 AND page_id // 6 % 2 = 0""")
def sitemap_tree(spark, sf):
    """Product URLs below an index of indexes, one of which names the first one again; three lists are named by none."""
    k = F.col("page_id")
    url = F.concat(F.lit("<url><loc>https://shop.example.com/"), pick(F.floor(k / 6), "products/", "about/"), k.cast("string"), F.lit("</loc></url>"))
    each = table(spark, sf, "pages").select((k % 6).cast("string").alias("n"), k, url.alias("url"))
    lists = each.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"]), "").alias("urls"))
    lists = lists.select(F.concat(F.lit("leaf"), "n", F.lit(".xml")).alias("file"), F.concat(F.lit("<urlset>"), "urls", F.lit("</urlset>")).alias("text"))
    named = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc>https://shop.example.com/{n}.xml</loc></sitemap>" for n in names) + "</sitemapindex>"
    indexes = [("top.xml", named("middle", "leaf0")), ("middle.xml", named("lower", "top", "leaf1")), ("lower.xml", named("leaf2", "middle", "lost"))]
    return P.sitemap_products(lists.unionByName(spark.createDataFrame(indexes, "file string, text string")), ["top.xml"])


WHOLE_HTML = CLEAN_HTML.removeprefix("substr(").removesuffix(", 1, 15000)").replace("(html,", "(repeat(html, 8),")


@query(f"SELECT page_id, CAST(length({WHOLE_HTML}) AS INTEGER) AS n, md5({WHOLE_HTML}) AS digest FROM pages")
def html_clean_whole(spark, sf):
    """Long pages, cleaned and not cut."""
    pages = table(spark, sf, "pages").select("page_id", F.repeat("html", F.lit(8)).alias("html"))
    return G.html_clean(pages, None).select("page_id", F.length("html").alias("n"), F.md5("html").alias("digest"))


def listing_pages(spark, sf):
    """Pages of listings whose next page is told in one of five ways, or not at all."""
    k = F.col("page_id")
    n = k.cast("string")
    html = pick(
        k % 6, F.concat(F.lit("<link rel='next' href='/r/"), n, F.lit("'>")), F.concat(F.lit('<p><a class="x" href="more/'), n, F.lit('">Next <i>page</i></a>')), F.lit("<p>no links</p>"),
        F.lit("<p>no links</p>"), F.concat(F.lit('<a href="/p/1">1</a> <a class="current" href="/p/2">2</a> <a href="/p/3/'), n, F.lit('">3</a>')), F.lit('<a href="/p/1">1</a>'),
    )
    url = F.concat(F.lit("https://shop.example.com/list"), pick(k % 6, "/a", "/b/c", F.concat(F.lit("?q=1&page="), n, F.lit("&z=2")), F.concat(F.lit("/page/"), n), "", ""))
    return table(spark, sf, "pages").select("page_id", url.alias("url"), html.alias("html"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://shop.example.com/r/' || page_id WHEN 1 THEN 'https://shop.example.com/list/b/more/' || page_id
    WHEN 2 THEN 'https://shop.example.com/list?q=1&page=' || (page_id + 1) || '&z=2' WHEN 3 THEN 'https://shop.example.com/list/page/' || (page_id + 1) || '/'
    WHEN 4 THEN 'https://shop.example.com/p/3/' || page_id END AS next FROM pages WHERE page_id % 6 < 5""")  # fmt: skip
def next_page_forms(spark, sf):
    return G.next_page(listing_pages(spark, sf))


def ruled_pages(spark, sf):
    """Product pages that only the rules of their domain can read, with titles that are too short or general on some."""
    k = F.col("sourceId").cast("long")
    title = F.when(k % 5 == 0, "Welcome to our home page").when(k % 5 == 1, "abc").otherwise(F.concat(F.lit("Item "), F.col("sourceId"), F.lit(" blue")))
    html = F.concat(F.lit("<h1 class='t'>"), title, F.lit("</h1><em>"), pick(k, F.concat(F.lit("EUR "), F.format_number(F.floor("price"), 2)), F.lit("ask us")), F.lit("</em><q>Only 2</q>"))
    return views.products(spark, sf).select(k.alias("page_id"), F.concat(F.lit("https://www.s"), (k % 3).cast("string"), F.lit(".com/p/"), "sourceId").alias("url"), html.alias("html"))


RULED = {"ruled": """SELECT p_partkey AS page_id, 'Item ' || p_partkey || ' blue' AS title, CAST(floor(price) AS DOUBLE) AS price FROM v_products WHERE p_partkey % 3 < 2 AND p_partkey % 5 > 1 AND p_partkey % 2 = 0"""}


def _ruled(spark, sf):
    rules = [(f"s{n}.com", field, pattern) for n in (0, 1) for field, pattern in (("title", "<h1[^>]*>([^<]*)"), ("price", "<em>([^<]*)"), ("availability", "<q>([^<]*)"))]
    return G.extract_cascade(ruled_pages(spark, sf), spark.createDataFrame(rules, "domain string, field string, pattern string"), G.FIELDS)


@query(sql("SELECT page_id, 'rules' AS via, title, price, 'EUR' AS currency, 'limited_stock' AS availability FROM ruled", **RULED))
def extract_cascade_rules(spark, sf):
    return _ruled(spark, sf).select("page_id", "via", "title", "price", "currency", "availability")


@query(sql("""SELECT 'rules' AS via, unnest(['brand', 'description', 'category', 'sku', 'images']) AS field, n AS missing FROM (SELECT count(*) AS n FROM ruled)""", **RULED))
def missing_fields(spark, sf):
    return G.missing_fields(_ruled(spark, sf))


@query("""SELECT page_id, 'https://shop.example.com/products/' || page_id AS link FROM pages WHERE page_id % 2 = 0""")
def product_links(spark, sf):
    """Links that look like products, of pages that also hold others."""
    k = F.col("page_id")
    html = F.concat(F.lit("<a href='/about'>x</a><a href=\"/blog/products/1\">y</a><a href="), pick(k, "products/", "collections/products/"), k.cast("string"), F.lit(">z</a><a href='https://other.org/products/1'>o</a>"))
    return G.product_links(table(spark, sf, "pages").select("page_id", F.lit("https://www.shop.example.com/index").alias("url"), html.alias("html"))).withColumn("link", F.replace("link", F.lit("www."), F.lit("")))


@query(sql("""SELECT "sourceId", unnest(list_filter([CASE WHEN length("sourceId") = 2 THEN 'required:name' END, CASE WHEN length("sourceId") > 3 THEN 'maxLength:name' END,
    CASE WHEN "sourceId" LIKE 'n1%' THEN 'parent:self' END], lambda e: e IS NOT NULL)) AS error
    FROM (SELECT 'r' || r_regionkey AS "sourceId" FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier)"""))  # fmt: skip
def validate_broken_categories(spark, sf):
    """Categories without a name, with a long one, or that are their own parent."""
    from shelfmark.operators import categories as K

    key = F.col("sourceId")
    name = F.when(F.length(key) == 2, " ").when(F.length(key) > 3, F.repeat(F.lit("n"), F.lit(256))).otherwise(F.col("name"))
    rows = category_rows(spark, sf).select("sourceId", name.alias("name"), F.when(key.startswith("n1"), key).otherwise(F.col("parentSourceId")).alias("parentSourceId"))
    return K.validate_categories(rows).select("sourceId", F.explode("errors").alias("error"))


@query(sql("""SELECT p_partkey AS id, 'last' AS size, 'x' AS "Fit" FROM v_products WHERE p_partkey % 50 = 0"""))
def norm_repeated_attributes(spark, sf):
    """Attributes of WooCommerce items of which a name is given twice: the last one counts."""
    k = F.col("sourceId").cast("long")
    attribute = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit(n.lower()).alias("slug"), F.array(F.lit(v)).alias("options"))
    items = P.empty_items(spark, "woocommerce", views.products(spark, sf).where(k % 50 == 0).select(k.alias("id"), F.array(attribute("Size", "first"), attribute("Fit", "x"), attribute("Size", "last")).alias("attributes")))
    rows = N.norm_woo_products(items, "s3")
    return rows.select(F.col("sourceId").cast("long").alias("id"), F.col("attributes")["Size"].alias("size"), F.col("attributes")["Fit"].alias("Fit"))

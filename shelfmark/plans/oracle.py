"""DuckDB SQL that gives the rows of the catalog queries, written apart from the operators."""

from __future__ import annotations

from shelfmark.plans.views_sql import canonical_id, sql, text_normalize

CANONICAL = """SELECT "canonicalProductId" AS "canonicalId", arg_min(title, o) AS title, arg_min(brand, o) AS brand,
    arg_min(category, o) AS category, arg_min(description, o) AS description, count(*) AS "productCount", min(price) AS "priceMin",
    max(price) AS "priceMax", arg_min(currency, o) AS currency, max("lastSyncedAt") AS "updatedAt",
    array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, bool_or(has_image) AS has_image
    FROM (SELECT *, ROW("lastSyncedAt", id) AS o FROM v_products) WHERE "canonicalProductId" IS NOT NULL GROUP BY ALL"""
PRICED = """SELECT * FROM v_offers WHERE "canonicalProductId" IS NOT NULL AND price IS NOT NULL"""
MODAL = """SELECT "canonicalProductId", arg_max(currency, ROW(run, -pos)) AS currency FROM (
    SELECT "canonicalProductId", currency, row_number() OVER (PARTITION BY "canonicalProductId" ORDER BY price, id) AS pos,
    row_number() OVER (PARTITION BY "canonicalProductId", currency ORDER BY price, id) AS run FROM priced) GROUP BY ALL"""
IN_STOCK = "availability IN ('in_stock', 'limited', 'limited_stock')"
SUMMARY = f"""SELECT "canonicalProductId", min(price) AS "lowestPrice", max(price) AS "highestPrice", count(*) AS "totalOffers",
    count(*) FILTER ({IN_STOCK}) AS "inStockCount", count(DISTINCT "storeId") FILTER ({IN_STOCK}) AS "availableStores", any_value(m.currency) AS currency
    FROM priced JOIN modal m USING ("canonicalProductId") GROUP BY ALL"""
OFFERS = {"priced": PRICED, "modal": MODAL, "summary": SUMMARY}
C = {"canonical": CANONICAL}
FLAT = 'SELECT "canonicalId", title, brand, category, description, "productCount", "priceMin", "priceMax", currency, "updatedAt", sources FROM canonical'
RULES = {
    "MISSING_IMAGES": ("warning", "NOT has_image"),
    "MISSING_BRAND": ("warning", "nullif(trim(brand), '') IS NULL"),
    "MISSING_TITLE": ("critical", "coalesce(trim(title), '') = ''"),
    "MISSING_PRICE": ("critical", '"priceMin" IS NULL AND "priceMax" IS NULL'),
    "INVALID_PRICE_VALUE": ("critical", '"priceMin" <= 0 OR "priceMax" <= 0'),
    "INVALID_PRICE_RANGE": ("critical", '"priceMin" > "priceMax"'),
    "TITLE_TOO_LONG": ("critical", "length(title) > 500"),
    "INVALID_TITLE": ("critical", "trim(title) <> '' AND NOT regexp_matches(title, '[A-Za-z]')"),
    "INVALID_CURRENCY": ("warning", "NOT regexp_matches(currency, '^[A-Z]{3}$')"),
}


def schema_issues(rows: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT "canonicalId" AS "canonicalProductId", '{code}' AS "issueCode", '{severity}' AS severity FROM {rows} WHERE {rule}"""
        for code, (severity, rule) in RULES.items()
    )


DETECTED = {**C, "detected": schema_issues("canonical")}
EVEN = "strpos('02468ace', substr(\"canonicalProductId\", -1, 1)) > 0"
ISSUES = {
    **DETECTED,
    "issues": f"""SELECT *, TIMESTAMP '2024-01-01' AS "detectedAt", {EVEN} AS resolved, CASE WHEN {EVEN} THEN TIMESTAMP '2024-01-01' END AS "resolvedAt" FROM detected""",
}
BASELINE = """SELECT "canonicalId", CASE WHEN length(title) % 2 = 0 THEN "priceMin" * 0.5 ELSE "priceMin" END AS price_history
    FROM canonical WHERE length(title) % 3 <> 0"""
NOW = "(SELECT t FROM v_now)"
LATEST = """SELECT "storeId", arg_max(status, ROW(ts, event_id)) AS "lastStatus", max(ts) AS "lastSync" FROM v_sync_metrics GROUP BY ALL"""
HOURLY = """SELECT endpoint, date_trunc('hour', ts) AS hour, count(*) AS requests, count(*) FILTER ("isError") AS errors,
    CAST(sum("durationMs") AS BIGINT) AS "totalMs" FROM v_api_calls GROUP BY ALL"""
STATUS = """SELECT s.id AS "storeId", s.name, s.platform, l."lastStatus", l."lastSync" FROM v_stores s LEFT JOIN latest l ON s.id = l."storeId" """
DAILY = f"""SELECT s.*, coalesce(d.n, 0) AS "syncsToday", CAST(coalesce(d.p, 0) AS BIGINT) AS "productsToday" FROM status s LEFT JOIN (
    SELECT "storeId", count(*) FILTER (ts >= date_trunc('day', {NOW})) AS n, sum("successProducts") FILTER (ts >= date_trunc('day', {NOW})) AS p
    FROM v_sync_metrics GROUP BY ALL) d USING ("storeId")"""
SYNCS = {"latest": LATEST, "status": STATUS, "daily": DAILY}
COUNTS = """SELECT s.id, s.name, s.platform, s.currency, s.country, s."isActive", count(DISTINCT p."canonicalProductId") AS "productCount"
    FROM v_stores s LEFT JOIN v_products p ON p."storeId" = s.id GROUP BY ALL"""
SHARED_SKU = """SELECT sku2 AS sku, count(DISTINCT "canonicalProductId") AS canonicals FROM shared WHERE sku2 IS NOT NULL AND "canonicalProductId" IS NOT NULL GROUP BY ALL HAVING canonicals > 1"""
SHARED = {"shared": "SELECT *, 'S' || right(sku, 2) AS sku2 FROM v_products", "sku_conflicts": SHARED_SKU}

# Similarity of titles: shared characters over the longer length.
CHARS = f"""SELECT *, {text_normalize("title")} AS name, {text_normalize("category")} AS cat, nullif(trim(lower(brand)), '') AS b FROM v_products"""
LETTERS = """SELECT id, unnest(string_split(replace(name, ' ', ''), '')) AS ch FROM features WHERE name <> ''"""
HISTOGRAM = "SELECT id, ch, count(*) AS n FROM letters GROUP BY ALL"


def pairs(block: str, cap: int) -> dict[str, str]:
    ranked = f"SELECT *, {block} AS block, row_number() OVER (PARTITION BY {block} ORDER BY id) AS r FROM features WHERE {block} IS NOT NULL"
    joined = f"""SELECT a.block AS block, a.id AS id, b.id AS match, a.price AS pa, b.price AS pb, a.sku AS sa, b.sku AS sb, a.size AS za, b.size AS zb,
        a.name AS na, b.name AS nb, CASE WHEN a.b IS NULL AND b.b IS NULL THEN 0.5::DOUBLE WHEN a.b = b.b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS brand,
        CASE WHEN a.cat = '' OR b.cat = '' THEN 0.5::DOUBLE WHEN a.cat = b.cat THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS category
        FROM ranked a JOIN ranked b ON a.block = b.block AND b.r <= {cap} AND a.id <> b.id
        WHERE NOT abs(a.price - b.price) / greatest(a.price, b.price) > 0.30"""
    common = "SELECT DISTINCT na, nb FROM pairs WHERE na <> '' AND nb <> ''"
    names = "SELECT name, ch, count(*) AS n FROM (SELECT DISTINCT name FROM features WHERE name <> ''), LATERAL (SELECT unnest(string_split(replace(name, ' ', ''), '')) AS ch) GROUP BY ALL"
    titles = """SELECT na, nb, sum(least(x.n, y.n)) / greatest(length(replace(na, ' ', '')), length(replace(nb, ' ', ''))) AS title
        FROM common JOIN names x ON x.name = na JOIN names y ON y.name = nb AND y.ch = x.ch GROUP BY na, nb"""
    return {"features": CHARS, "ranked": ranked, "pairs": joined, "common": common, "names": names, "titles": titles}


DEDUP = {
    **pairs("CASE WHEN cat <> '' THEN 'c:' || cat ELSE 'b:' || b END", 100),
    "scored": """SELECT id, match, round(coalesce(title, 0) * 0.4::DOUBLE + brand * 0.2::DOUBLE + (1 - abs(pa - pb) / greatest(pa, pb)) * 0.3::DOUBLE + category * 0.1::DOUBLE, 6) AS score
        FROM pairs LEFT JOIN titles USING (na, nb)""",
    "matched": "SELECT * FROM scored WHERE score >= 0.8",
}
ENTITY = {
    **pairs("CASE WHEN cat <> '' AND b IS NOT NULL THEN 'cb|' || cat || '|' || b WHEN b IS NOT NULL THEN 'b|' || b WHEN cat <> '' THEN 'c|' || cat END", 200),
    "based": """SELECT *, coalesce(title, 0) * 0.35::DOUBLE + brand * 0.2::DOUBLE + (1 - abs(pa - pb) / greatest(pa, pb)) * 0.25::DOUBLE + category * 0.1::DOUBLE
        + CASE WHEN za = zb THEN 1 ELSE 0 END * 0.1::DOUBLE AS base FROM pairs LEFT JOIN titles USING (na, nb)""",
    "scored": """SELECT id, match, round(CASE WHEN sa IS NOT NULL AND sb IS NOT NULL AND sa = sb THEN 1 WHEN sa IS NOT NULL AND sb IS NOT NULL THEN least(0.7::DOUBLE, base)
        ELSE least(1.0::DOUBLE, base) END, 6) AS score FROM based""",
    "matched": "SELECT * FROM scored WHERE score >= 0.8",
}
# Without a cap: a probe meets every row that carries its key.
NEAR = """SELECT a.id AS id, b.id AS match, a.price AS pa, b.price AS pb, a.sku AS sa, b.sku AS sb, a.size AS za, b.size AS zb, a.name AS na, b.name AS nb,
        a.cat AS ca, b.cat AS cb, a.b AS ba, b.b AS bb, CASE WHEN a.b IS NULL AND b.b IS NULL THEN 0.5::DOUBLE WHEN a.b = b.b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS brand,
        CASE WHEN a.cat = '' OR b.cat = '' THEN 0.5::DOUBLE WHEN a.cat = b.cat THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS category
        FROM features a JOIN features b ON a.id <> b.id AND NOT abs(a.price - b.price) / greatest(a.price, b.price) > 0.30"""
TOKENS = "list_filter(string_split({}, ' '), lambda t: t <> '')"
KEYED = f"""SELECT * FROM near WHERE CASE WHEN ca <> '' AND ba IS NOT NULL THEN ca = cb AND ba = bb WHEN ba IS NOT NULL THEN ba = bb WHEN ca <> '' THEN ca = cb
        WHEN len({TOKENS.format("na")}) >= 3 THEN list_has_any({TOKENS.format("na")}[1:3], {TOKENS.format("nb")}) END"""
ENTITY_WHOLE = {"features": CHARS, "near": NEAR, "pairs": KEYED} | {k: ENTITY[k] for k in ("common", "names", "titles", "based", "scored", "matched")}
BEST = "SELECT id, arg_min(match, ROW(-score, match)) AS match, max(score) AS score FROM matched GROUP BY id"
RESOLVED = """SELECT p.id, CASE WHEN nullif(trim(lower(brand)), '') IS NULL AND nullif(trim(category), '') IS NULL THEN 'skipped'
    WHEN match IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS state, match, score FROM v_products p LEFT JOIN best USING (id)"""

PRIORITY = "CASE source WHEN 'shopify' THEN 1 WHEN 'magento' THEN 2 WHEN 'woocommerce' THEN 3 WHEN 'bigcommerce' THEN 4 WHEN 'unicommerce' THEN 5 WHEN 'scraped' THEN 6 ELSE 99 END"
SIDES = {
    "ranked_products": f"""SELECT *, {PRIORITY} AS pr FROM v_products WHERE "canonicalProductId" IS NOT NULL""",
    "old": """SELECT * FROM ranked_products WHERE source IN ('shopify', 'magento') QUALIFY row_number() OVER (PARTITION BY "canonicalProductId" ORDER BY id) = 1""",
    "new": "SELECT * FROM ranked_products WHERE source NOT IN ('shopify', 'magento')",
}
WINNER = """CASE WHEN i IS NULL THEN ROW('existing', 'null_fallback') WHEN e IS NULL THEN ROW('incoming', 'null_fallback')
    WHEN pe < pi THEN ROW('existing', 'source_priority') WHEN pi < pe THEN ROW('incoming', 'source_priority') ELSE ROW('?', '?') END"""
CONFLICTS = " UNION ALL ".join(
    f"""SELECT "canonicalProductId", new.id AS "productId", '{f}' AS field, old.{f} AS e, new.{f} AS i, old.pr AS pe, new.pr AS pi FROM old JOIN new USING ("canonicalProductId")"""
    for f in ("title", "brand", "category", "description")
)
CONFLICT = {
    **SIDES,
    "told": CONFLICTS,
    "conflicts": f"""SELECT "canonicalProductId", "productId", field, w[1] AS winner, w[2] AS reason, CASE WHEN w[1] = 'incoming' THEN i ELSE e END AS value
        FROM (SELECT *, [({WINNER})[1], ({WINNER})[2]] AS w FROM told WHERE coalesce(e, '') <> coalesce(i, ''))""",
}
DOMAIN = r"""regexp_extract(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', ''), '([^.]+\.[^.]+)$', 1)"""
LINKS = {
    "links": """SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) AS href FROM pages""",
    "absolute": """SELECT page_id, url, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || href WHEN regexp_matches(href, '^[a-zA-Z]+://') THEN href END AS link FROM links""",
}
HOST = r"regexp_replace(lower(regexp_extract({}, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '')"
EXTRACT = {
    "made": """SELECT p_partkey AS page_id, nullif(title, '') AS title, CAST(floor(price) AS DOUBLE) AS price, currency, coalesce(brand, '') AS brand FROM v_products""",
    "cascade": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'jsonld' ELSE 'opengraph' END AS via, title, price, currency,
        CASE WHEN page_id % 2 = 0 THEN brand ELSE nullif(brand, '') END AS brand FROM made WHERE (page_id % 2 = 0 OR page_id % 3 = 0) AND length(title) >= 5""",
}

STOCK = "p_partkey % 25"
CLEAN = """trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))"""
BRAND = "nullif(trim(lower(brand)), '')"
TIME = """ "lastSyncedAt" AS "updatedAt" """


def normalised(**columns: str) -> str:
    """Columns of a normalised product of the products view."""
    base = {
        "sourceId": '"sourceId"', "cleanedTitle": CLEAN, "normalizedBrand": BRAND, "category": "category", "sku": "sku", "compareAtPrice": "NULL", "price": "CAST(floor(price) AS DOUBLE)",
        "quantity": f"CAST({STOCK} AS DOUBLE)", "isInStock": f"{STOCK} > 0", "n_images": "CAST(has_image AS INTEGER)", "n_variants": "1", "updatedAt": '"lastSyncedAt"',
    }
    return sql("SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in (base | columns).items()) + " FROM v_products")


SNAPSHOTS = f"""SELECT *, CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE {STOCK} END::DOUBLE AS total, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 6 ELSE 0 END::DOUBLE AS blocked, greatest(0, total - blocked) AS free FROM v_products"""
FREE = "CASE WHEN free <= 0 THEN 'out_of_stock' WHEN free <= 10 THEN 'limited' ELSE 'in_stock' END"

TREE = """SELECT 'r' || r_regionkey AS "sourceId", r_name AS name, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey FROM supplier"""
CATEGORY_ID = "'cat_' || substr(sha256({}), 1, 16)"
T = {"tree": TREE, "named": f"""SELECT t."sourceId", t.name, t.parent, {CATEGORY_ID.format('t."sourceId"')} AS id, {CATEGORY_ID.format('p."sourceId"')} AS "parentId" FROM tree t LEFT JOIN tree p ON p."sourceId" = t.parent"""}
LINKED = f"""SELECT "sourceId" AS id, array_to_string(list_sort(list_filter([CASE WHEN p_partkey % 30 < 25 THEN {CATEGORY_ID.format("'n' || (p_partkey % 30)")} END, {CATEGORY_ID.format("'r' || (p_partkey % 5)")}],
    lambda x: x IS NOT NULL)), ',') AS "categoryIds", CAST(p_partkey % 30 >= 25 AS BIGINT) AS missing FROM v_products"""


def variants(side: int) -> str:
    return f"""SELECT "canonicalProductId" AS c, CAST(p_partkey % 7 AS VARCHAR) AS v, arg_min(ROW(CASE WHEN price < 1400 THEN price END, status, {PRIORITY}), id) AS r FROM v_products
        WHERE "canonicalProductId" IS NOT NULL AND p_partkey % 2 = {side} GROUP BY ALL"""


OFFER_KEYS = """SELECT *, split_part("productId", '_', 2) AS s, 'store_' || (CAST(split_part("productId", '_', 2) AS BIGINT) % 10) AS st FROM v_offers"""
ARCHIVE = """SELECT 'shopify' AS platform, 'gid://shopify/Product/' || p_partkey AS "sourceId", false AS untouched FROM v_products UNION ALL
    SELECT unnest(['magento', 'woocommerce', 'bigcommerce']), CAST(p_partkey AS VARCHAR), false FROM v_products UNION ALL
    SELECT 'unicommerce', 'SKU-' || p_partkey, true FROM v_products WHERE CAST(p_partkey AS VARCHAR) < '5'"""

WORDS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
HITS = "len(list_filter({}, lambda w: w IN ('the', 'that', 'version')))"
HEAD = "array_to_string(string_split(text, ' ')[1:8], ' ')"


def weighted(field: str, weight: int) -> str:
    words = WORDS.format(field)
    hits = HITS.format(words)
    return f"CASE WHEN {hits} > 0 THEN {weight} * {hits} / sqrt(len({words})) ELSE 0 END"


CLEAN_HTML = r"""substr(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
    '(?is)<(?:script|style|nav|footer|header|iframe|noscript)\b[^>]*>.*?</(?:script|style|nav|footer|header|iframe|noscript)>', '', 'g'),
    '(?i)\s(?:on[a-z]+|style)=(?:"[^"]*"|''[^'']*'')', '', 'g'), 1, 15000)"""
FOUND_ISSUES = {**ISSUES, "cheap": 'SELECT * FROM canonical WHERE "priceMin" < 1200', "found": schema_issues("cheap")}

SQL = {
    "scan_shopify": sql("""SELECT 'gid://shopify/Product/' || p_partkey AS id, coalesce(brand, ' ') AS vendor, 2 AS n_variants FROM v_products"""),
    "scan_magento": sql("SELECT p_partkey AS id, title AS name, floor(price) AS price FROM v_products"),
    "scan_woocommerce": sql(f"SELECT p_partkey AS id, title AS name, CASE {STOCK} WHEN 0 THEN 'outofstock' WHEN 1 THEN 'onbackorder' ELSE 'instock' END AS stock_status FROM v_products"),
    "scan_bigcommerce": sql("SELECT p_partkey AS id, title AS name, CASE p_partkey % 25 WHEN 1 THEN 'One' WHEN 2 THEN 'Two' END AS brand_name FROM v_products"),
    "scan_unicommerce": sql(f"""SELECT 'SKU-' || p_partkey AS "itemTypeSKU", CASE WHEN p_partkey % 8 = 0 THEN 'none' ELSE CAST({STOCK} AS VARCHAR) END AS inventory FROM v_products"""),
    "scan_sitemap": "SELECT DISTINCT url FROM pages",
    "join_brand_lookup": sql("SELECT p_partkey AS id, CASE WHEN p_partkey % 25 < 20 THEN 'House ' || (p_partkey % 25) END AS brand_name FROM v_products"),
    "search_fulltext": f"SELECT doc_id AS id, round({weighted(HEAD, 10)} + {weighted('text', 1)}, 6) AS score FROM documents WHERE score > 0 ORDER BY 2 DESC, 1 LIMIT 20",
    "html_clean": f"SELECT page_id, CAST(length({CLEAN_HTML}) AS INTEGER) AS n, md5({CLEAN_HTML}) AS digest FROM pages",
    "offers_bigcommerce": sql(f"""SELECT "sourceId", 's4' AS "storeId", floor(price) - CASE WHEN p_partkey % 4 = 0 THEN 100 ELSE 0 END AS price,
        CASE WHEN p_partkey % 4 = 0 THEN round(150 / (floor(price) + 50) * 100, 2) WHEN p_partkey % 2 = 0 THEN round(50 / (floor(price) + 50) * 100, 2) END AS "discountPercent",
        CASE WHEN p_partkey % 3 <> 0 THEN {STOCK} END AS "stockQty", CASE WHEN p_partkey % 3 = 0 THEN 'in_stock' WHEN {STOCK} = 0 THEN 'out_of_stock' WHEN {STOCK} <= 10 THEN 'limited' ELSE 'in_stock' END AS availability FROM v_products"""),
    "norm_webhook_rest": sql("""SELECT 'gid://shopify/Product/' || p_partkey AS id, title, brand AS vendor, 'a|b' AS tags, CASE WHEN currency <> 'USD' THEN currency ELSE 'INR' END AS "currencyCode" FROM v_products"""),
    "norm_scraped": sql("""SELECT CAST(page_id AS VARCHAR) AS "sourceId", title AS "cleanedTitle", nullif(lower(brand), '') AS "normalizedBrand", price, 'active' AS status FROM cascade""", **EXTRACT),
    "join_inventory_item": sql("""SELECT user_id AS item, event_id, CASE WHEN user_id % 8 = 0 THEN p.sku WHEN user_id % 4 = 0 THEN p.sku || '-b' END AS sku FROM v_webhooks LEFT JOIN v_products p ON p_partkey = user_id WHERE topic = 'inventory'"""),
    "join_shopify_collections": sql("""SELECT p.id, 'own' || coalesce(',' || n.id, '') AS "categoryIds" FROM v_products p LEFT JOIN named n ON n."sourceId" = 'n' || (length(p.title) % 25)""", **T),
    "join_magento_categories": sql(f"""SELECT "sourceId" AS id, CASE WHEN p_partkey % 7 < 5 THEN {CATEGORY_ID.format("'r' || (p_partkey % 7)")} ELSE '' END AS "categoryIds", CAST(p_partkey % 7 >= 5 AS BIGINT) AS missing FROM v_products"""),
    "page_issues": sql(f"""SELECT "canonicalProductId", "issueCode", coalesce(i."detectedAt", {NOW}) AS "detectedAt" FROM found f LEFT JOIN issues i USING ("canonicalProductId", "issueCode") ORDER BY 3 DESC, 1, 2 LIMIT 20""", **FOUND_ISSUES),
    "er_block_join": sql("SELECT block, count(*) AS pairs FROM pairs GROUP BY block", **pairs("CASE WHEN cat <> '' THEN cat END", 50)),
    "join_parent_category": sql('SELECT "sourceId", name, id, "parentId" FROM named', **T),
    "norm_woo_categories": sql('SELECT id, "sourceId", name, "parentId", CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS level FROM named', **T),
    "norm_shopify_categories": sql("""SELECT "sourceId", name, 0 AS level, CASE WHEN length("sourceId") = 2 THEN length(name) ELSE 0 END AS "productsCount" FROM tree""", **T),
    "norm_bigcommerce_categories": sql("""SELECT "sourceId", name, name AS slug, parent AS "parentSourceId", CASE left("sourceId", 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END AS level FROM tree""", **T),
    "norm_magento_categories": sql("""SELECT "sourceId", name, CASE WHEN left("sourceId", 1) = 's' THEN parent END AS "parentId", CASE left("sourceId", 1) WHEN 'n' THEN 1 ELSE 2 END AS level
        FROM tree WHERE parent IS NOT NULL""", **T),
    "join_woo_categories": sql(LINKED),
    "unmatched_categories": sql("SELECT id, missing FROM linked WHERE missing > 0", linked=LINKED),
    "validate_categories": sql("""SELECT "sourceId", CASE WHEN length("sourceId") <= 2 THEN 'required:name' ELSE '' END AS errors FROM tree""", **T),
    "resolve_variants": sql("""SELECT coalesce(e.c, i.c) AS "canonicalId", coalesce(e.v, i.v) AS "variantId", CASE WHEN i.c IS NULL OR e.r[3] <= i.r[3] THEN coalesce(e.r[1], i.r[1]) ELSE coalesce(i.r[1], e.r[1]) END AS price,
        CASE WHEN i.c IS NULL OR e.r[3] <= i.r[3] THEN coalesce(e.r[2], i.r[2]) ELSE coalesce(i.r[2], e.r[2]) END AS availability,
        CASE WHEN e.c IS NOT NULL AND i.c IS NOT NULL THEN 'updated' WHEN i.c IS NOT NULL THEN 'added' ELSE 'kept' END AS state
        FROM old_variants e FULL JOIN new_variants i ON e.c = i.c AND e.v = i.v""", old_variants=variants(0), new_variants=variants(1)),
    "upsert_offer_keys": sql("""SELECT s AS "sourceId", st AS "storeId", id AS "variantId", price + 1 AS price, "productId" FROM keys WHERE "stockQty" % 5 <> 0 AND price + 1 < 20000
        UNION ALL SELECT s, st, CASE WHEN "stockQty" % 3 <> 0 THEN id END, price, "productId" FROM keys k WHERE NOT ("stockQty" % 3 <> 0 AND "stockQty" % 5 <> 0 AND price + 1 < 20000)
        AND NOT ("stockQty" % 3 = 0 AND EXISTS (SELECT 1 FROM keys n WHERE n.s = k.s AND n."stockQty" % 5 <> 0 AND n.price + 1 < 20000))""", keys=OFFER_KEYS),
    "array_element_patch": sql(f"""SELECT 'gid://shopify/Product/' || p_partkey AS "sourceId", CAST(coalesce(q.m, {STOCK}) AS DOUBLE) AS first, 0::DOUBLE AS second, coalesce(q.m, {STOCK}) > 0 AS stocked
        FROM v_products p LEFT JOIN (SELECT sku, max("stockQty") AS m FROM v_offers GROUP BY ALL) q ON q.sku = p.sku"""),
    "raw_archive": sql(ARCHIVE),
    "dead_letter_log": sql(f"""SELECT event_id AS "jobId", CASE WHEN event_id % 5 = 0 THEN 'resolved' ELSE 'pending_review' END AS state, ts AS "failedAt", CASE WHEN event_id % 5 = 0 THEN {NOW} END AS "resolvedAt"
        FROM v_sync_metrics WHERE status = 'failed' AND (event_id % 3 <> 0 OR event_id % 2 = 0)"""),
    "join_canonical_full": sql("""SELECT c."canonicalId", c.title, c."productCount" AS "sourceRows", o.n AS "offerRows", o.m AS "lowestPrice" FROM canonical c
        LEFT JOIN (SELECT "canonicalProductId", count(*) AS n, min(price) AS m FROM v_offers GROUP BY ALL) o ON o."canonicalProductId" = c."canonicalId" """, **C),
    "search_context": sql("""SELECT 'Found ' || count(*) || ' products for ''ring'' on ' || (SELECT array_to_string(list_sort(list(DISTINCT source)), ', ') FROM v_products WHERE "canonicalProductId" IN (SELECT "canonicalId" FROM canonical WHERE title LIKE '%ring%'))
        || ' from ' || format('{:.2f}', min("priceMin")) || ' to ' || format('{:.2f}', max("priceMax")) || ' ' || arg_min(currency, "priceMin") AS context FROM canonical WHERE title LIKE '%ring%'""", **C),
    "ai_search_view": sql("""SELECT c."canonicalId", title, concat_ws(' - ', CASE WHEN brand IS NULL OR starts_with(lower(title), lower(brand)) THEN title ELSE brand || ' ' || title END, category) AS summary, cheapest
        FROM (SELECT * FROM canonical WHERE strpos(lower(title), 'ri') > 0 OR strpos(lower(coalesce(brand, '')), 'ri') > 0 ORDER BY title, "canonicalId" LIMIT 5) c
        LEFT JOIN (SELECT "canonicalProductId", min(price) AS cheapest FROM v_offers GROUP BY ALL) o ON o."canonicalProductId" = c."canonicalId" """, **C),
    "redact_secrets": sql("SELECT id, '[redacted]' AS key, country FROM v_stores"),
    "dq_ai_contract": sql("""SELECT "canonicalId", 'brand' AS field FROM canonical WHERE brand IS NULL UNION ALL SELECT "canonicalId", 'category' FROM canonical WHERE category IS NULL""", **C),
    "next_page": r"""SELECT page_id, regexp_extract(url, '^(.*?[?&]page=)', 1) || (CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT) + 1) || regexp_extract(url, '[?&]page=[0-9]+(.*)$', 1) AS next
        FROM pages WHERE regexp_matches(url, '[?&]page=[0-9]+')""",
    "extract_domain_rules": f"""SELECT page_id, 'lang' AS field, regexp_extract(html, '<html lang="([a-z]+)', 1) AS value FROM pages WHERE {DOMAIN} LIKE '%.com' AND regexp_matches(html, '<html lang="[a-z]+')""",
    "offers_magento": sql(f"""SELECT "sourceId", 's2' AS "storeId", sku AS "variantId", floor(price) AS price, 'INR' AS currency,
        CASE WHEN {STOCK} = 0 THEN 'out_of_stock' WHEN {STOCK} <= 10 THEN 'limited' ELSE 'in_stock' END AS availability, CAST({STOCK} AS DOUBLE) AS "stockQty" FROM v_products WHERE sku IS NOT NULL"""),
    "scraped_pipeline": sql(f"""SELECT x AS "canonicalId", min(e.price) AS lowest, count(*) AS offers, coalesce(bool_or(c."productCount" > 1), false) AS known
        FROM (SELECT *, {canonical_id("title", "brand")} AS x FROM cascade) e LEFT JOIN canonical c ON c."canonicalId" = x GROUP BY x""", **C, **EXTRACT),
    "scan_raw_replay": sql("""SELECT 'gid://shopify/Product/' || p_partkey AS id, coalesce(brand, ' ') AS vendor, 2 AS n_variants FROM v_products"""),
    "scan_incremental": sql("""SELECT p_partkey AS id, strftime("lastSyncedAt", '%Y-%m-%d %H:%M:%S') AS updated_at FROM v_products WHERE "lastSyncedAt" >= TIMESTAMP '2024-01-03 12:00:00'"""),
    "norm_shopify_products": normalised(sourceId="'gid://shopify/Product/' || p_partkey", cleanedTitle="trim(coalesce(title, '') || ' x')", status="CASE WHEN p_partkey % 3 = 0 THEN 'active' ELSE 'draft' END",
        variantId="'v' || p_partkey", compareAtPrice="CASE WHEN p_partkey % 2 = 0 THEN floor(price) + 10 END", n_variants="2"),
    "norm_magento_products": normalised(status="CASE p_partkey % 3 WHEN 1 THEN 'active' WHEN 2 THEN 'inactive' END", variantId="sku", n_images="CAST(has_image AS INTEGER) + CAST(p_partkey % 2 <> 0 AS INTEGER)", keys="'[size]'"),
    "norm_woo_products": normalised(status="CASE WHEN p_partkey % 4 = 0 THEN 'inactive' ELSE 'active' END", variantId="coalesce(sku, CAST(p_partkey AS VARCHAR))", compareAtPrice="CASE WHEN p_partkey % 2 = 0 THEN floor(price) + 100 END",
        quantity=f"CASE WHEN p_partkey % 3 = 0 THEN CAST({STOCK} AS DOUBLE) END", isInStock=f"{STOCK} > 1", description="description", size="size || ', u'"),
    "norm_bigcommerce_products": normalised(status="CASE WHEN p_partkey % 5 = 0 THEN 'preorder' WHEN p_partkey % 7 = 0 THEN 'inactive' ELSE 'active' END", category="NULL",
        normalizedBrand="CASE WHEN p_partkey % 25 < 20 THEN 'house ' || (p_partkey % 25) END", variantId="CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE coalesce(sku, CAST(p_partkey AS VARCHAR)) END",
        price="floor(price) + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END", compareAtPrice="CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 <> 0 THEN floor(price) + 1 END", tags="'a,b,c'",
        variantTitle="CASE WHEN p_partkey % 2 = 0 THEN 'M / Red' END"),
    "norm_inventory": sql(f"""SELECT 'SKU-' || p_partkey AS sku, 'f' || (p_partkey % 3) AS "facilityCode", free AS "availableInventory", total AS "totalInventory", blocked AS "blockedInventory",
        {FREE} AS availability, free > 0 AS "isInStock", 's5' AS "storeId" FROM snapshots""", snapshots=SNAPSHOTS),
    "offers_from_variants": sql(f"""SELECT 'shopify' AS source, 's1' AS "storeId", v || p_partkey AS "variantId", CASE WHEN v = 'v' THEN sku END AS sku, CASE WHEN v = 'v' THEN floor(price) ELSE 0 END AS price,
        CASE WHEN v = 'v' AND p_partkey % 2 = 0 THEN floor(price) + 10 END AS "compareAtPrice", currency, CASE WHEN v = 'v' AND {STOCK} > 0 THEN 'in_stock' ELSE 'out_of_stock' END AS availability,
        v = 'v' AND {STOCK} > 0 AS "isInStock" FROM v_products, (VALUES ('v'), ('w')) t(v)"""),
    "offers_woo": sql(f"""SELECT "sourceId", 's3' AS "storeId", coalesce(sku, CAST(p_partkey AS VARCHAR)) AS "variantId", floor(price) AS price,
        CASE WHEN p_partkey % 2 = 0 THEN round(100 / (floor(price) + 100) * 100, 2) END AS "discountPercent",
        CASE WHEN {STOCK} = 0 THEN 'out_of_stock' WHEN {STOCK} = 1 THEN 'on_backorder' WHEN p_partkey % 3 = 0 AND {STOCK} <= 10 THEN 'limited' ELSE 'in_stock' END AS availability FROM v_products"""),
    "join_inventory_sku": sql(f"""SELECT o.id, CASE WHEN s.p_partkey IS NULL THEN o.availability ELSE {FREE} END AS availability, CASE WHEN s.p_partkey IS NULL THEN o."isInStock" ELSE free > 0 END AS "isInStock",
        s.p_partkey IS NOT NULL AS matched FROM v_offers o LEFT JOIN snapshots s ON 'SKU-' || s.p_partkey = o.sku AND s.p_partkey % 3 <> 0""", snapshots=SNAPSHOTS),
    "anti_unmatched_inventory": sql("""SELECT 'SKU-' || p_partkey AS sku FROM v_products WHERE 'SKU-' || p_partkey NOT IN (SELECT sku FROM v_offers WHERE "stockQty" > 25)"""),
    "offer_summary": sql("SELECT * FROM summary", **OFFERS),
    "modal_currency": sql("SELECT * FROM modal", **OFFERS),
    "bulk_offer_summary": sql("""SELECT "canonicalProductId", "lowestPrice", "highestPrice", coalesce("totalOffers", 0) AS "totalOffers",
        coalesce("inStockCount", 0) AS "inStockCount", coalesce("availableStores", 0) AS "availableStores", currency FROM (
        SELECT DISTINCT "canonicalProductId" FROM v_products WHERE source = 'shopify' AND "canonicalProductId" IS NOT NULL) LEFT JOIN summary USING ("canonicalProductId")""", **OFFERS),
    "offer_list": sql("""SELECT "canonicalProductId", CAST(row_number() OVER (PARTITION BY "canonicalProductId" ORDER BY price, o.id) AS INTEGER) AS position, o.id, s.name AS "storeName", price, availability
        FROM priced o LEFT JOIN v_stores s ON s.id = o."storeId" """, **OFFERS),
    "offer_by_product": sql("""SELECT "canonicalProductId", min(price) AS "minPrice", max(price) AS "maxPrice", arg_min("storeId", ROW(price, id)) AS "minStore",
        arg_min("storeId", ROW(-price, id)) AS "maxStore", bool_or(availability IN ('in_stock', 'limited')) AS "inStock", count(*) AS "totalOffers" FROM priced GROUP BY ALL""", **OFFERS),
    "price_range_sync": sql("""SELECT "canonicalId", title, coalesce("lowestPrice", "priceMin") AS "priceMin", coalesce("highestPrice", "priceMax") AS "priceMax",
        coalesce(s.currency, c.currency) AS currency FROM canonical c LEFT JOIN summary s ON s."canonicalProductId" = c."canonicalId" """, **C, **OFFERS),
    "offer_rollup_totals": sql("""SELECT count(*) AS products, CAST(sum(n) AS BIGINT) AS offers, count(*) FILTER (n > 1) AS "multiOfferProducts", round(sum(n) / count(*), 2) AS "averageOffers"
        FROM (SELECT count(*) AS n FROM priced GROUP BY "canonicalProductId")""", **OFFERS),
    "join_offer_store": sql("""SELECT o.id, s.name AS "storeName", s.platform, price FROM v_offers o LEFT JOIN v_stores s ON s.id = o."storeId" """),
    "join_offer_product": sql("""SELECT o.id, c.title, c.brand, o.price FROM v_offers o LEFT JOIN canonical c ON c."canonicalId" = o."canonicalProductId" """, **C),
    "join_offer_canonical_backfill": sql("""SELECT id, "canonicalProductId", "stockQty" % 3 = 0 AND "canonicalProductId" IS NOT NULL AS backfilled FROM v_offers"""),
    "canonical_merge": sql(FLAT, **C),
    "golden_record": sql("""SELECT "canonicalProductId" AS "canonicalId", """ + ", ".join(
        f"""arg_min({f}, ROW({PRIORITY}, -epoch_us("lastSyncedAt"), -length({f}), id)) AS {f}""" for f in ("title", "brand", "category", "description", "sku"))
        + """ FROM v_products WHERE "canonicalProductId" IS NOT NULL GROUP BY ALL"""),
    "resolve_product": sql("SELECT * FROM conflicts", **CONFLICT),
    "conflict_report": sql("SELECT field, reason, winner, count(*) AS conflicts FROM conflicts GROUP BY ALL", **CONFLICT),
    "merge_matched": sql("""SELECT coalesce(o.id, n.id) AS id, n.title, n.brand, coalesce(n.sku, o.sku) AS sku, coalesce(n.category, o.category) AS category FROM
        (SELECT * FROM v_products WHERE source <> 'shopify' AND title IS NOT NULL AND brand IS NOT NULL) n LEFT JOIN
        (SELECT * FROM v_products WHERE source = 'shopify' QUALIFY row_number() OVER (PARTITION BY title, brand ORDER BY id) = 1) o ON o.title = n.title AND o.brand = n.brand"""),
    "deactivate_products": sql("SELECT id, CASE WHEN price > 1500 THEN 'inactive' ELSE status END AS status FROM v_products"),
    "deactivate_offers": sql("""SELECT o.id, CASE WHEN p.price > 1500 THEN 'out_of_stock' ELSE availability END AS availability, "isInStock" AND p.price <= 1500 AS "isInStock"
        FROM v_offers o JOIN v_products p ON p.id = o."productId" """),
    "ingestion_metrics": sql(f"""SELECT platform, count(*) AS syncs, CAST(sum("successProducts") AS BIGINT) AS products, count(*) FILTER (status = 'success') AS success,
        count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'partial') AS partial, CAST(sum("durationMs") AS BIGINT) AS "durationMs",
        round(100 * count(*) FILTER (status = 'success') / count(*), 1) AS "successRate" FROM v_sync_metrics WHERE ts >= {NOW} - INTERVAL 1 DAY GROUP BY GROUPING SETS ((), (platform))"""),
    "api_metrics_hourly": sql("SELECT * FROM hourly", hourly=HOURLY),
    "api_metrics_last_hour": sql(f"""SELECT endpoint, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum("totalMs") AS BIGINT) AS "totalMs",
        round(100 * sum(errors) / sum(requests), 4) AS "errorRate", round(sum("totalMs") / sum(requests), 4) AS "averageMs"
        FROM hourly WHERE hour >= date_trunc('hour', {NOW} - INTERVAL 1 HOUR) GROUP BY ALL""", hourly=HOURLY),
    "api_slowest": sql(f"""SELECT endpoint, round(sum("totalMs") / sum(requests), 6) AS "averageMs" FROM hourly WHERE hour >= {NOW} - INTERVAL 1 DAY
        GROUP BY endpoint ORDER BY sum("totalMs") / sum(requests) DESC, endpoint LIMIT 3""", hourly=HOURLY),
    "cursor_state": sql("""SELECT "storeId", max(ts) FILTER (status = 'success') AS since, since IS NULL AS "isFullSync" FROM v_sync_metrics GROUP BY ALL"""),
    "sync_status": sql("SELECT * FROM status", **SYNCS),
    "store_metrics": sql("SELECT * FROM daily", **SYNCS),
    "store_totals": sql("""SELECT count(*) AS stores, count(*) FILTER ("lastStatus" = 'success') AS active, count(*) FILTER ("syncsToday" > 0) AS "syncedToday",
        count(*) FILTER ("lastSync" IS NULL) AS "neverSynced" FROM daily""", **SYNCS),
    "dead_letters": sql("""SELECT event_id AS "jobId", "storeId", platform, 'pending_review' AS state, ts AS "failedAt" FROM v_sync_metrics WHERE status = 'failed'"""),
    "retention": sql(f"SELECT event_id, ts FROM v_sync_metrics WHERE ts >= {NOW} - INTERVAL 7 DAY"),
    "health_rollup": sql("""SELECT pending, critical, CASE WHEN pending >= 5 OR critical >= 10 THEN 'degraded' ELSE 'healthy' END AS status FROM
        (SELECT count(*) AS pending FROM v_sync_metrics WHERE status = 'failed'), (SELECT count(*) FILTER (severity = 'critical' AND NOT resolved) AS critical FROM issues)""", **ISSUES),
    "issue_summary": sql("""SELECT "issueCode", severity, count(*) AS issues FROM issues WHERE NOT resolved GROUP BY ALL ORDER BY 3 DESC, 1 LIMIT 10""", **ISSUES),
    "dq_schema": sql("SELECT * FROM detected", **DETECTED),
    "dq_anomaly": sql(f"""SELECT "canonicalId" AS "canonicalProductId", 'ANOMALOUS_PRICE_CHANGE' AS "issueCode", 'critical' AS severity FROM canonical JOIN baseline USING ("canonicalId")
        WHERE price_history > 0 AND abs("priceMin" - price_history) / price_history > 0.5
        UNION ALL SELECT "canonicalId", 'NO_OFFERS', 'warning' FROM canonical WHERE "canonicalId" NOT IN (SELECT "canonicalProductId" FROM v_offers WHERE "canonicalProductId" IS NOT NULL)
        UNION ALL SELECT "canonicalProductId", 'NO_STOCK_AVAILABLE', 'warning' FROM v_offers WHERE "canonicalProductId" IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (availability IN ('inStock', 'in_stock')) = 0
        UNION ALL SELECT "canonicalId", 'STALE_PRODUCT', 'warning' FROM canonical WHERE "updatedAt" < {NOW} - INTERVAL 30 DAY""", **C, baseline=BASELINE),
    "dq_consistency": sql("""SELECT DISTINCT "canonicalProductId", 'SKU_CONFLICT' AS "issueCode", 'critical' AS severity FROM shared JOIN sku_conflicts c ON c.sku = sku2
        WHERE "canonicalProductId" IS NOT NULL UNION ALL SELECT "canonicalProductId", 'BRAND_CONFLICT', 'warning' FROM v_products WHERE "canonicalProductId" IS NOT NULL
        GROUP BY ALL HAVING count(DISTINCT nullif(trim(lower(brand)), '')) > 1""", **SHARED),
    "xjoin_sku_conflict": sql("SELECT * FROM sku_conflicts", **SHARED),
    "price_change": sql("""SELECT "canonicalId", round(CASE WHEN price_history > 0 THEN abs("priceMin" - price_history) / price_history END, 6) AS change
        FROM canonical LEFT JOIN baseline USING ("canonicalId")""", **C, baseline=BASELINE),
    "dq_upsert": sql(f"""SELECT "canonicalProductId", "issueCode", coalesce(f.severity, i.severity) AS severity, coalesce(i."detectedAt", {NOW}) AS "detectedAt", f.severity IS NULL AS resolved,
        CASE WHEN f.severity IS NULL THEN coalesce(i."resolvedAt", {NOW}) END AS "resolvedAt" FROM issues i FULL JOIN found f USING ("canonicalProductId", "issueCode")""",
        **ISSUES, cheap='SELECT * FROM canonical WHERE "priceMin" < 1200', found=schema_issues("cheap")),
    "dq_run_summary": sql("""SELECT checked, issues, critical, warning, "productsWithIssues" FROM (SELECT count(*) AS checked FROM canonical), (SELECT count(*) AS issues,
        count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(DISTINCT "canonicalProductId") AS "productsWithIssues" FROM detected)""", **DETECTED),
    "dq_incremental": sql("SELECT * FROM found", **C, touched="""SELECT * FROM canonical WHERE "canonicalId" IN (SELECT "canonicalProductId" FROM v_products WHERE source = 'magento')""", found=schema_issues("touched")),
    "dq_baseline_update": sql("""SELECT "canonicalId", "priceMin" AS price_history FROM canonical""", **C),
    "dq_resolve_manual": sql(f"""SELECT "canonicalProductId", "issueCode", severity, "detectedAt", CASE WHEN "issueCode" = 'MISSING_BRAND' AND NOT resolved THEN {NOW} ELSE "resolvedAt" END AS "resolvedAt",
        resolved OR "issueCode" = 'MISSING_BRAND' AS resolved FROM issues""", **ISSUES),
    "filter_issues": sql("""SELECT "canonicalProductId", "issueCode" FROM issues WHERE severity = 'warning' AND NOT resolved""", **ISSUES),
    "validate_products": sql("SELECT id, CASE WHEN title IS NULL THEN 'required:title' ELSE '' END AS errors FROM v_products"),
    "ingest_completeness": sql("""SELECT source, "storeId", count(*) AS total, count(*) FILTER (title IS NULL) AS invalid, count(*) FILTER (brand IS NULL) AS "missingBrands",
        count(*) FILTER (sku IS NULL) AS "missingSkus", count("canonicalProductId") AS mapped, count("canonicalProductId") - count(DISTINCT "canonicalProductId") AS duplicates FROM v_products GROUP BY ALL"""),
    "dedup_pairs": sql("SELECT * FROM matched", **DEDUP),
    "entity_pairs": sql("SELECT * FROM matched", **ENTITY_WHOLE),
    "best_match": sql("SELECT * FROM best", **DEDUP, best=BEST),
    "entity_resolve_all": sql("SELECT * FROM resolved", **ENTITY, best=BEST, resolved=RESOLVED),
    "resolution_summary": sql("""SELECT count(*) AS total, count(*) FILTER (state = 'resolved') AS resolved, count(*) FILTER (state = 'unresolved') AS unresolved,
        count(*) FILTER (state = 'skipped') AS skipped, round(count(*) FILTER (state = 'resolved') / (count(*) - count(*) FILTER (state = 'skipped')), 6) AS rate FROM states""", **ENTITY, best=BEST, states=RESOLVED),
    "canonical_group": sql("""SELECT p.id, p."canonicalProductId" AS "canonicalId", CASE WHEN p."canonicalProductId" IS NULL THEN 'skipped' WHEN c."productCount" > 1 THEN 'reused' ELSE 'new' END AS state
        FROM v_products p LEFT JOIN canonical c ON c."canonicalId" = p."canonicalProductId" """, **C),
    "join_existing_match": sql(r"""SELECT n.id, coalesce(s.m, k.m) AS match, CASE WHEN s.m IS NOT NULL THEN 'sku' WHEN k.m IS NOT NULL THEN 'groupingKey' ELSE 'none' END AS "matchType"
        FROM (SELECT * FROM v_products WHERE source <> 'shopify') n
        LEFT JOIN (SELECT "storeId", sku, min(id) AS m FROM v_products WHERE source = 'shopify' AND sku IS NOT NULL GROUP BY ALL) s ON s."storeId" = n."storeId" AND s.sku = n.sku
        LEFT JOIN (SELECT "storeId", lower(brand) AS b, lower(title) AS t, min(id) AS m FROM v_products WHERE source = 'shopify' AND brand IS NOT NULL AND title IS NOT NULL GROUP BY ALL) k
        ON k."storeId" = n."storeId" AND k.b = lower(n.brand) AND k.t = lower(n.title)"""),
    "filter_products": sql(FLAT + " WHERE category = 'ECONOMY' AND lower(brand) = 'brand#2' AND strpos(sources, 'shopify') > 0", **C),
    "filter_availability": sql(FLAT + """ WHERE "canonicalId" IN (SELECT "canonicalProductId" FROM v_offers WHERE NOT "isInStock")""", **C),
    "filter_price_containment": sql(FLAT + ' WHERE "priceMin" >= 1000 AND "priceMax" <= 1400', **C),
    "page_products": sql(FLAT + ' ORDER BY "priceMin", "canonicalId" LIMIT 20 OFFSET 20', **C),
    "page_search": sql(FLAT + ' ORDER BY "priceMax" DESC, "canonicalId" LIMIT 20', **C),
    "product_view": sql('SELECT "canonicalId" AS id, title, "priceMin" AS lo, "priceMax" AS hi FROM canonical', **C),
    "store_product_counts": sql(COUNTS),
    "semi_store_catalog": sql(FLAT + """ WHERE "canonicalId" IN (SELECT "canonicalProductId" FROM v_products WHERE "storeId" = 'store_3')""", **C),
    "page_store_catalog": sql(FLAT + """ WHERE "canonicalId" IN (SELECT "canonicalProductId" FROM v_products WHERE "storeId" = 'store_3') ORDER BY "updatedAt" DESC, "canonicalId" LIMIT 20""", **C),
    "page_store_offers": sql("""SELECT o.id, c.title, c.brand, o.price, o.availability, o."lastSyncedAt" FROM (SELECT * FROM v_offers WHERE "storeId" = 'store_3' ORDER BY "lastSyncedAt" DESC, id LIMIT 50) o
        LEFT JOIN canonical c ON c."canonicalId" = o."canonicalProductId" """, **C),
    "page_stores": sql("SELECT * FROM counts ORDER BY name, id LIMIT 20", counts=COUNTS),
    "page_ai_catalog": sql("""SELECT "canonicalId", title, brand, category, "priceMin", currency, CAST(len(string_split(sources, ',')) AS INTEGER) AS "sourceCount"
        FROM canonical ORDER BY "updatedAt" DESC, "canonicalId" LIMIT 50""", **C),
    "lookup_by_id": sql(FLAT + """ WHERE "canonicalId" IN (SELECT "canonicalProductId" FROM v_products WHERE price > 1700)""", **C),
    "join_product_sources": sql("""SELECT p."canonicalProductId" AS "canonicalId", p.source, p."sourceId", p."storeId", p.title, p.price, s.name AS "storeName" FROM (SELECT * FROM v_products
        WHERE "canonicalProductId" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "canonicalProductId", source ORDER BY id) = 1) p LEFT JOIN v_stores s ON s.id = p."storeId" """),
    "search_suggest": sql("""SELECT "canonicalId", title, brand FROM canonical WHERE strpos(lower(title), 'ri') > 0 OR strpos(lower(coalesce(brand, '')), 'ri') > 0 ORDER BY title, "canonicalId" LIMIT 8""", **C),
    "ai_product_view": sql("""SELECT "canonicalId", coalesce(title, '') AS title, coalesce(brand, '') AS brand, coalesce(category, 'Uncategorized') AS category, coalesce(currency, 'USD') AS currency,
        coalesce("priceMin", 0) AS "priceMin", coalesce("priceMax", 0) AS "priceMax", coalesce(n, 0) AS "totalOffers", coalesce(k, 0) AS "inStockOffers", coalesce(k, 0) > 0 AS "isAvailable",
        "priceMax" > "priceMin" AS "hasVariablePricing", concat_ws(' - ', CASE WHEN brand IS NULL OR starts_with(lower(title), lower(brand)) THEN title ELSE brand || ' ' || title END, category) AS summary
        FROM canonical LEFT JOIN (SELECT "canonicalProductId", count(*) AS n, count(*) FILTER ("isInStock") AS k FROM v_offers GROUP BY ALL) o ON o."canonicalProductId" = "canonicalId" """, **C),
    "ai_catalog_view": sql("""SELECT "canonicalId", title, brand, category, "priceMin", currency, CAST(len(string_split(sources, ',')) AS INTEGER) AS "sourceCount" FROM canonical""", **C),
    "ai_price_context": sql("""SELECT "canonicalId", CASE WHEN o.n IS NULL AND "priceMin" IS NULL THEN 'Price unavailable'
        WHEN o.n IS NULL THEN 'Listed from ' || format('{:.2f}', "priceMin") || ' ' || coalesce(c.currency, 'USD') WHEN k = 0 THEN 'Out of stock at all stores'
        ELSE CASE WHEN k = 1 THEN 'Available at ' ELSE 'Cheapest at ' END || names[1] || ' for ' || format('{:.2f}', coalesce(prices[1], 0)) || ' ' || coalesce(currencies[1], 'USD')
            || CASE WHEN k = 1 THEN '' ELSE ', also available at ' || array_to_string(names[2:], ', ') END END AS context FROM canonical c
        LEFT JOIN (SELECT "canonicalProductId", count(*) AS n FROM v_offers GROUP BY ALL) o ON o."canonicalProductId" = "canonicalId"
        LEFT JOIN (SELECT "canonicalProductId", count(*) FILTER ("isInStock") AS k, list(coalesce(name, 'Unknown Store') ORDER BY price NULLS LAST, p.id) FILTER ("isInStock") AS names,
            list(price ORDER BY price NULLS LAST, p.id) FILTER ("isInStock") AS prices, list(p.currency ORDER BY price NULLS LAST, p.id) FILTER ("isInStock") AS currencies
            FROM v_offers p LEFT JOIN v_stores s ON s.id = p."storeId" GROUP BY ALL) b ON b."canonicalProductId" = "canonicalId" """, **C),
    "upsert_replace": sql("""SELECT "sourceId", source, "storeId", title, CASE WHEN price > 1300 THEN price + 1 ELSE price END AS price, "lastSyncedAt" FROM v_products"""),
    "upsert_patch": sql("""SELECT id, CASE WHEN price < 1500 THEN title END AS title, CASE WHEN price > 1300 THEN price + 1 ELSE price END AS price, CASE WHEN price < 1500 THEN status END AS status FROM v_products"""),
    "insert_only": sql("SELECT id, title, CASE WHEN price >= 1500 THEN price + 1 ELSE price END AS price FROM v_products"),
    "domain_normalize": f"SELECT page_id, url, {DOMAIN} AS domain FROM pages",
    "platform_detect": """SELECT page_id, CASE WHEN strpos(lower(html), 'cdn.shopify.com') > 0 THEN 'shopify' WHEN strpos(lower(html), 'bigcommerce') > 0 THEN 'bigcommerce'
        WHEN strpos(lower(html), 'woocommerce') > 0 THEN 'woocommerce' WHEN strpos(lower(html), 'magento') > 0 THEN 'magento' ELSE 'custom' END AS platform FROM pages""",
    "link_extract": "WITH " + ", ".join(f"{k} AS ({v})" for k, v in LINKS.items()) + f" SELECT DISTINCT page_id, link FROM absolute WHERE link IS NOT NULL AND {HOST.format('link')} = {HOST.format('url')}",
    "store_discover": f"""WITH d AS (SELECT page_id, {DOMAIN} AS domain FROM pages) SELECT domain, count(*) AS pages, 'store_' || substr(sha256(domain), 1, 16) AS id FROM d
        WHERE domain <> '' AND domain NOT IN (SELECT domain FROM d WHERE page_id % 10 = 0) GROUP BY ALL""",
    "extract_jsonld": sql("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN coalesce(title, '') END AS title, CASE WHEN page_id % 2 = 0 THEN price END AS price,
        CASE WHEN page_id % 2 = 0 THEN currency END AS currency, CASE WHEN page_id % 2 = 0 THEN brand END AS brand FROM made""", **EXTRACT),
    "extract_opengraph": sql("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN title END AS title, CASE WHEN page_id % 3 = 0 THEN price END AS price,
        CASE WHEN page_id % 3 = 0 THEN currency END AS currency, CASE WHEN page_id % 3 = 0 THEN nullif(brand, '') END AS brand FROM made""", **EXTRACT),
    "extract_cascade": sql("SELECT * FROM cascade", **EXTRACT),
    "stream_delete": sql("""SELECT id, CASE WHEN p_partkey IN (SELECT user_id FROM v_webhooks WHERE topic = 'delete') THEN 'inactive' ELSE status END AS status FROM v_products"""),
    "stream_inventory": sql("""SELECT o.id, o.sku, CASE WHEN e.u IS NULL THEN o."stockQty" ELSE e.q END AS "stockQty", CASE WHEN e.u IS NULL THEN o.availability WHEN e.q IS NULL THEN 'in_stock' WHEN e.q = 0 THEN 'out_of_stock'
        WHEN e.q <= 10 THEN 'limited' ELSE 'in_stock' END AS availability, CASE WHEN e.u IS NULL THEN o."isInStock" ELSE e.q IS NULL OR e.q <> 0 END AS "isInStock" FROM v_offers o
        LEFT JOIN (SELECT user_id AS u, CASE WHEN value < 100 THEN CAST(floor(value) AS BIGINT) END AS q FROM v_webhooks WHERE topic = 'inventory' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e
        ON 'SKU-' || e.u = o.sku"""),
    "stream_product_upsert": sql("""SELECT coalesce(e.k, p."sourceId") AS "sourceId", coalesce(e.value, p.price) AS price, e.ts AS "lastSyncedAt" FROM v_products p FULL JOIN
        (SELECT CASE WHEN user_id < 50 THEN '' ELSE 'u' END || user_id AS k, value, ts FROM v_webhooks WHERE topic IN ('create', 'update') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e
        ON e.k = p."sourceId" """),
    "stream_incremental_sync": sql("""SELECT user_id, max(ts) AS since FROM v_webhooks WHERE user_id % 3 <> 0 OR topic <> 'delete' GROUP BY user_id HAVING count(*) FILTER (topic = 'delete') = 0"""),
    "stream_dedup": sql('SELECT DISTINCT "webhookId", topic FROM v_webhooks'),
    "stream_api_hourly": sql("SELECT * FROM hourly", hourly=HOURLY),
    "stream_latest_state": sql("SELECT user_id, \"webhookId\", topic, ts, event_id, value FROM v_webhooks QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "stream_late_reject": sql("SELECT event_id, topic FROM v_webhooks WHERE epoch(date_trunc('second', ts + to_seconds(CAST(floor(value * 2) AS BIGINT)))) - epoch(date_trunc('second', ts)) > 300"),
    "stream_route": sql("SELECT event_id, topic AS handler FROM v_webhooks WHERE topic <> 'unhandled'"),
    "extraction_coverage": sql("""SELECT via, count(*) AS pages, count(title) AS with_title, count(price) AS with_price, count(currency) AS with_currency, count(brand) AS with_brand FROM cascade GROUP BY ALL""", **EXTRACT),
}

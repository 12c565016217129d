"""The same views in DuckDB SQL, as common table expressions."""

from shelfmark.functions.exprs import ABBREVIATIONS, FILLERS
from shelfmark.plans.views import CURRENCIES, SOURCES, TOPICS


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def text_normalize(x: str) -> str:
    words = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ABBREVIATIONS.items()) + "}"
    part = f"list_filter(list_transform(string_split(t, '-'), lambda p: coalesce({words}[p], p)), lambda p: p <> '' AND NOT list_contains({_list(FILLERS)}, p))"
    tokens = f"string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+')"
    return f"array_to_string(list_filter(list_transform({tokens}, lambda t: array_to_string({part}, '-')), lambda t: t <> ''), ' ')"


def canonical_id(title: str, brand: str) -> str:
    name = text_normalize(title)
    return f"CASE WHEN {name} <> '' THEN 'cprod_' || substr(sha256({name} || '|' || coalesce(nullif(trim(lower({brand})), ''), '')), 1, 24) END"


AVAILABILITY = "CASE WHEN q IS NULL THEN 'in_stock' WHEN q = 0 THEN 'out_of_stock' WHEN q <= 10 THEN 'limited' ELSE 'in_stock' END"

CTES = {
    "v_stores": f"""SELECT 'store_' || s_suppkey AS id, s_name AS name, ({_list(SOURCES)})[s_suppkey % 6 + 1] AS platform,
        ({_list(CURRENCIES)})[s_nationkey % 3 + 1] AS currency, n_name AS country, s_suppkey % 7 <> 0 AS "isActive"
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_raw_products": f"""SELECT 'prod_' || p_partkey AS id, p_partkey, CAST(p_partkey AS VARCHAR) AS "sourceId",
        ({_list(SOURCES)})[p_partkey % 6 + 1] AS source, 'store_' || (p_partkey % 10) AS "storeId",
        CASE WHEN p_partkey % 4 = 0 THEN 'SKU-' || p_partkey END AS sku,
        CASE WHEN p_partkey % 41 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS brand,
        CASE WHEN p_partkey % 17 <> 0 THEN p_type END AS category,
        CASE WHEN p_partkey % 5 <> 0 THEN p_name || ' by ' || p_brand END AS description,
        CASE WHEN p_partkey % 11 = 0 THEN 'inactive' ELSE 'active' END AS status,
        p_retailprice * (1 + p_size / 50.0) AS price, ({_list(CURRENCIES)})[p_partkey % 3 + 1] AS currency,
        CAST(p_size AS VARCHAR) AS size, p_partkey % 20 <> 0 AS has_image,
        TIMESTAMP '2024-01-01' + to_hours(p_partkey) AS "lastSyncedAt" FROM part""",
    "v_products": f"""SELECT *, {canonical_id("title", "brand")} AS "canonicalProductId" FROM v_raw_products""",
    "v_raw_offers": """SELECT l_partkey, l_suppkey, min(l_extendedprice) AS price, CAST(sum(l_quantity) AS BIGINT) % 30 AS q,
        max(l_shipdate) AS "lastSyncedAt" FROM lineitem GROUP BY ALL""",
    "v_offers": f"""SELECT 'offer_' || l_partkey || '_' || l_suppkey AS id, 'prod_' || l_partkey AS "productId",
        'store_' || l_suppkey AS "storeId", 'SKU-' || l_partkey AS sku, o.price, ({_list(CURRENCIES)})[l_suppkey % 3 + 1] AS currency,
        {AVAILABILITY} AS availability, {AVAILABILITY} <> 'out_of_stock' AS "isInStock", q AS "stockQty", o."lastSyncedAt", p."canonicalProductId"
        FROM v_raw_offers o JOIN v_products p ON p.p_partkey = l_partkey""",
    "v_webhooks": f"""SELECT user_id || '-' || json_extract_string(props, '$.k') AS "webhookId",
        MAP {{{", ".join(f"'{k}': '{v}'" for k, v in TOPICS.items())}}}[event_type] AS topic, ts, event_id, user_id, value FROM events""",
    "v_sync_metrics": f"""SELECT event_id, 'store_' || (user_id % 100) AS "storeId", ({_list(SOURCES)})[user_id % 6 + 1] AS platform,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'success' END AS status,
        CAST(floor(value) AS BIGINT) AS "successProducts", CAST(floor(value * 1000) AS BIGINT) AS "durationMs", ts FROM events""",
    "v_api_calls": """SELECT event_type AS endpoint, event_type = 'error' AS "isError", CAST(floor(value * 10) AS BIGINT) AS "durationMs", ts FROM events""",
    "v_now": "SELECT max(ts) AS t FROM events",
}


def sql(query: str, **more: str) -> str:
    """A query with the views (and ``more`` ones, in order) that can be named in it."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in (CTES | more).items()) + f" {query}"

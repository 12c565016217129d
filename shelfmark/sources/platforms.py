"""Landed payloads of commerce platforms: their schemas, and scans of files of them as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.exprs import is_product_url, unescape
from shelfmark.sources.shared import stored

# Shapes of the payloads (fixed by the platforms).
SHOPIFY_NODE = (
    "id string, title string, description string, vendor string, productType string, status string, tags array<string>, createdAt string, updatedAt string, "
    "priceRangeV2 struct<minVariantPrice: struct<amount: string, currencyCode: string>>, "
    "variants struct<edges: array<struct<node: struct<id: string, title: string, sku: string, price: string, compareAtPrice: string, inventoryQuantity: long>>>>, "
    "media struct<edges: array<struct<node: struct<preview: struct<image: struct<url: string>>>>>>"
)
MAGENTO_ITEM = (
    "id long, sku string, name string, price double, status int, type_id string, weight double, created_at string, updated_at string, "
    "custom_attributes array<struct<attribute_code: string, value: string>>, "
    "extension_attributes struct<category_links: array<struct<category_id: string, position: int>>, stock_item: struct<qty: double, is_in_stock: boolean>>, "
    "media_gallery_entries array<struct<label: string, position: int, disabled: boolean, file: string>>"
)
WOO_ITEM = (
    "id long, sku string, name string, description string, price string, regular_price string, sale_price string, on_sale boolean, manage_stock boolean, stock_quantity long, "
    "stock_status string, weight string, status string, type string, date_created string, date_modified string, categories array<struct<id: long, name: string>>, "
    "tags array<struct<name: string>>, images array<struct<src: string, alt: string>>, brands array<struct<name: string>>, attributes array<struct<name: string, slug: string, options: array<string>>>"
)
BIGCOMMERCE_ITEM = (
    "id long, name string, sku string, description string, price double, retail_price double, sale_price double, is_visible boolean, availability string, brand_id long, categories array<long>, "
    "inventory_level long, inventory_tracking string, search_keywords string, weight double, type string, date_created string, date_modified string, "
    "primary_image struct<url_standard: string, description: string>, images array<struct<url_standard: string, url_zoom: string>>, custom_fields array<struct<name: string, value: string>>, "
    "variants array<struct<id: long, sku: string, price: double, retail_price: double, inventory_level: long, image_url: string, option_values: array<struct<option_display_name: string, label: string>>>>"
)
SCHEMAS = {"shopify": SHOPIFY_NODE, "magento": MAGENTO_ITEM, "woocommerce": WOO_ITEM, "bigcommerce": BIGCOMMERCE_ITEM}
SNAPSHOT = "itemTypeSKU string, facilityCode string, inventory string, blockedInventory string"


def _landed(spark: SparkSession, path: str, schema: str, one_per_file: bool) -> DataFrame:
    """Landed pages, one a line, which large files can be split at, or one a file."""
    return spark.read.schema(schema).option("multiLine", str(one_per_file).lower()).json(path)


def scan_shopify(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """One row per product node."""
    pages = _landed(spark, path, f"data struct<products: struct<edges: array<struct<node: struct<{_nested(SHOPIFY_NODE)}>>>>>", one_per_file)
    return pages.select(F.explode("data.products.edges").alias("e")).where("e.node is not null").select("e.node.*")


def scan_magento(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    pages = _landed(spark, path, f"products struct<items: array<struct<{_nested(MAGENTO_ITEM)}>>>", one_per_file)
    return pages.select(F.explode("products.items").alias("i")).where("i is not null").select("i.*")


def scan_woocommerce(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    pages = _landed(spark, path, f"products array<struct<{_nested(WOO_ITEM)}>>", one_per_file)
    return pages.select(F.explode("products").alias("i")).where("i is not null").select("i.*")


def scan_bigcommerce(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Products with the names of their brands."""
    pages = _landed(spark, path, f"productsAPI struct<data: array<struct<{_nested(BIGCOMMERCE_ITEM)}>>>, brandsAPI struct<data: array<struct<id: long, name: string>>>", one_per_file)
    brands = pages.select(F.explode("brandsAPI.data").alias("b")).select(F.col("b.id").alias("brand_id"), F.col("b.name").alias("brand_name")).dropDuplicates(["brand_id"])
    items = pages.select(F.explode("productsAPI.data").alias("i")).where("i is not null").select("i.*")
    return join_brand_lookup(items, brands)


def join_brand_lookup(items: DataFrame, brands: DataFrame) -> DataFrame:
    """Items with brand_name of their brand_id, null for an unknown one."""
    return items.join(brands, "brand_id", "left")


def scan_unicommerce(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    pages = _landed(spark, path, f"inventoryAPI struct<inventorySnapshots: array<struct<{_nested(SNAPSHOT)}>>>", one_per_file)
    return pages.select(F.explode("inventoryAPI.inventorySnapshots").alias("i")).where("i is not null").select("i.*")


def _nested(fields: str) -> str:
    """Top-level fields of a schema as fields of a struct."""
    out, depth = [], 0
    for part in fields.split(", "):
        out.append(part.replace(" ", ": ", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def scan_incremental(rows: DataFrame, times: list[Column], since: str | None) -> DataFrame:
    """Rows changed at ``since`` or later; a missing time is the epoch; without ``since`` all rows."""
    if since is None:
        return rows
    changed = F.coalesce(*[F.try_to_timestamp(t) for t in times], F.lit("1970-01-01").cast("timestamp"))
    return rows.where(changed >= F.lit(since).cast("timestamp"))


def scan_raw_replay(bronze: DataFrame, platform: str, schema: str) -> DataFrame:
    """Payloads of a platform parsed again from the archive (platform, sourceId, payload)."""
    # A list of one keeps the test for null from parsing each payload, and making it, a second time.
    parsed = bronze.where(F.col("platform") == platform).select(F.explode(F.array(F.from_json("payload", schema))).alias("p"))
    return parsed.where("p is not null").select("p.*")


def scan_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """Distinct URLs of landed sitemap files."""
    locations = F.regexp_extract_all("value", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)
    return spark.read.text(path, wholetext=True).select(F.explode(locations).alias("url")).distinct()


def last_part(url: Column) -> Column:
    """The last part of a URL's path, by which sitemaps are matched with landed files."""
    return F.regexp_extract(url, r"([^/?#]+)(?:[?#].*)?$", 1)


def locations(text: Column, parent: str) -> Column:
    """The first location of each ``parent`` element. Texts are split, so their length doesn't matter to the pattern."""
    elements = F.transform(F.split(text, rf"(?i)<{parent}\b"), lambda e: F.get(F.split(e, rf"(?i)</{parent}>"), 0))
    found = F.transform(F.slice(elements, 2, F.greatest(F.size(elements) - 1, F.lit(0))), lambda e: F.regexp_extract(e, r"(?i)<loc>\s*([^<\s]+)\s*</loc>", 1))
    return F.filter(found, lambda u: u != "")


def reached_sitemaps(told: DataFrame, start: list[str]) -> DataFrame:
    """Those of ``told`` (file, urls, maps) that ``start`` leads to over any number of indexes; each is visited once."""
    links = stored(told.select("file", F.explode("maps").alias("m")).select("file", last_part(F.col("m")).alias("to")).distinct(), "sitemap-links")
    reached = stored(told.where(F.col("file").isin(start)).select("file").distinct(), "sitemaps")
    frontier = reached
    while not frontier.isEmpty():
        named = links.join(frontier, "file", "left_semi").select(F.col("to").alias("file")).distinct()
        frontier = stored(named.join(reached, "file", "left_anti"), "sitemaps")
        reached = reached.unionByName(frontier)
    return told.join(reached, "file", "left_semi")


def sitemap_products(files: DataFrame, start: list[str] | None = None) -> DataFrame:
    """Distinct product URLs of sitemaps (file, text): XML lists of URLs, indexes of further sitemaps, or a URL a line.

    With ``start``, names of files, only these count and the sitemaps that they name, directly or through other indexes;
    an index that has been visited isn't followed again, so cycles end. A file that names sitemaps gives no URLs of its own.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda line: F.trim(line)), lambda line: line != "")
    is_xml, none = F.ltrim("text").startswith("<"), F.array().cast("array<string>")
    told = files.select("file", F.when(is_xml, locations(F.col("text"), "url")).otherwise(lines).alias("urls"), F.when(is_xml, locations(F.col("text"), "sitemap")).otherwise(none).alias("maps"))
    told = told if start is None else reached_sitemaps(stored(told, "sitemap-files"), start)
    urls = told.where(F.size("maps") == 0).select(F.explode("urls").alias("url")).select(unescape(F.col("url")).alias("url")).distinct()
    return urls.where(is_product_url(F.col("url")))


def scan_product_sitemaps(spark: SparkSession, path: str, start: list[str] | None = None) -> DataFrame:
    """Distinct product URLs of landed sitemap files (see ``sitemap_products``)."""
    files = spark.read.text(path, wholetext=True).select(last_part(F.input_file_name()).alias("file"), F.col("value").alias("text"))
    return sitemap_products(files, start)


def empty_items(spark: SparkSession, platform: str, known: DataFrame) -> DataFrame:
    """``known`` with the platform's other payload columns, all null."""
    schema = spark.createDataFrame([], SCHEMAS[platform]).schema
    return known.select(*[known[f.name] if f.name in known.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

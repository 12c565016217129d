"""Platform payloads made from the products view, as landed JSON texts, and the queries that normalise them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import normalize as N
from shelfmark.plans import views
from shelfmark.sources import platforms as P
from shelfmark.sources.shared import shared_folder
from shelfmark.sources.tables import table

BASE_URL = "https://shop.example.com"


def bronze(spark: SparkSession, sf: str, *platforms: str) -> DataFrame:
    """(platform, sourceId, payload): every product as a payload of each of the ``platforms``, or of all."""
    p = views.products(spark, sf).withColumn("k", F.col("sourceId").cast("long"))
    k, text = F.col("k"), F.col("sourceId")
    price = F.floor("price")
    stock = k % 25
    made = lambda **fields: F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    attribute = lambda code, value: F.struct(F.lit(code).alias("attribute_code"), value.alias("value"))
    node = lambda **fields: F.struct(F.struct(*[c.alias(n) for n, c in fields.items()]).alias("node"))
    shopify = made(
        id=F.concat(F.lit("gid://shopify/Product/"), text), title=F.concat(F.lit("<b>"), F.coalesce("title", F.lit("")), F.lit("</b>™  x ")), vendor=F.coalesce("brand", F.lit(" ")),
        productType=F.col("category"), status=F.when(k % 3 == 0, "ACTIVE").otherwise("DRAFT"), description=F.col("description"), tags=F.array("currency"), updatedAt=F.date_format("lastSyncedAt", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        priceRangeV2=F.struct(F.struct(F.col("currency").alias("currencyCode")).alias("minVariantPrice")),
        variants=F.struct(F.array(
            node(id=F.concat(F.lit("v"), text), sku=F.col("sku"), price=price.cast("string"), compareAtPrice=F.when(k % 2 == 0, (price + 10).cast("string")).otherwise(price.cast("string")), inventoryQuantity=stock),
            node(id=F.concat(F.lit("w"), text), sku=F.lit(None).cast("string"), price=F.lit("n/a"), compareAtPrice=F.lit(None).cast("string"), inventoryQuantity=F.lit(0)),
        ).alias("edges")),
        media=F.struct(F.array(node(preview=F.struct(F.struct(F.get("images", 0).alias("url")).alias("image")))).alias("edges")),
    )
    magento = made(
        id=k, sku=F.coalesce("sku", F.lit("")), name=F.col("title"), price=price.cast("double"), status=(k % 3).cast("int"), type_id=F.lit("simple"), updated_at=F.date_format("lastSyncedAt", "yyyy-MM-dd HH:mm:ss"),
        custom_attributes=F.array(attribute("brand", F.col("brand")), attribute("category", F.col("category")), attribute("size", F.col("attributes")["size"]), attribute("color", F.lit(" "))),
        extension_attributes=F.struct(F.struct(stock.cast("double").alias("qty"), (stock > 0).alias("is_in_stock")).alias("stock_item")),
        media_gallery_entries=F.array(
            F.struct(F.lit("a").alias("label"), F.lit(1).alias("position"), (k % 2 == 0).alias("disabled"), F.concat(F.lit("/"), text, F.lit(".jpg")).alias("file")),
            F.struct(F.lit("").alias("label"), F.lit(2).alias("position"), F.lit(False).alias("disabled"), F.get("images", 0).alias("file")),
        ),
    )
    woo = made(
        id=k, sku=F.col("sku"), name=F.col("title"), description=F.concat(F.lit("<p>"), F.coalesce("description", F.lit("")), F.lit("</p>")), price=price.cast("string"), regular_price=(price + 100).cast("string"),
        sale_price=F.when(k % 2 == 0, price.cast("string")).otherwise(""), on_sale=k % 2 == 0, manage_stock=k % 3 == 0, stock_quantity=stock,
        stock_status=F.when(stock == 0, "outofstock").when(stock == 1, "onbackorder").otherwise("instock"), status=F.when(k % 4 == 0, "private").otherwise("publish"),
        categories=F.array(F.struct((k % 9).alias("id"), F.col("category").alias("name"))), images=F.array(F.struct(F.get("images", 0).alias("src"))),
        brands=F.when(k % 2 == 0, F.array(F.struct(F.col("brand").alias("name")))), date_modified=F.date_format("lastSyncedAt", "yyyy-MM-dd'T'HH:mm:ss"),
        attributes=F.array(F.struct(F.lit("Brand").alias("name"), F.lit("pa_brand").alias("slug"), F.array("brand").alias("options")), F.struct(F.lit("Size").alias("name"), F.lit("pa_size").alias("slug"), F.array(F.col("attributes")["size"], F.lit("u")).alias("options"))),
    )
    big = made(
        id=k, name=F.col("title"), sku=F.col("sku"), price=price.cast("double"), is_visible=k % 7 != 0, availability=F.when(k % 5 == 0, "preorder").otherwise("available"), brand_id=k % 25, inventory_level=stock,
        search_keywords=F.lit("a, b,,c "), primary_image=F.struct(F.get("images", 0).alias("url_standard")), categories=F.array(k % 9, k % 9),
        variants=F.when(k % 2 == 0, F.array(F.struct(
            k.alias("id"), F.col("sku"), F.when(k % 4 == 0, (price + 1).cast("double")).alias("price"), (price + 1).cast("double").alias("retail_price"), stock.alias("inventory_level"), F.get("images", 0).alias("image_url"),
            F.array(F.struct(F.lit("Size").alias("option_display_name"), F.lit("M").alias("label")), F.struct(F.lit("Color").alias("option_display_name"), F.lit("Red").alias("label"))).alias("option_values"),
        ))),
        date_modified=F.date_format("lastSyncedAt", "yyyy-MM-dd'T'HH:mm:ss"),
    )
    stocks = made(itemTypeSKU=F.concat(F.lit("SKU-"), text), facilityCode=F.concat(F.lit("f"), (k % 3).cast("string")), inventory=F.when(k % 8 == 0, "none").otherwise(stock.cast("string")), blockedInventory=F.when(k % 2 == 0, (k % 6).cast("string")))
    each = {"shopify": shopify, "magento": magento, "woocommerce": woo, "bigcommerce": big, "unicommerce": stocks}
    # Made for one platform where one is asked for; a filter behind the list would come after all five.
    made_for = [F.struct(F.lit(n).alias("platform"), "sourceId", each[n].alias("payload")) for n in platforms or each]
    return p.select((made_for[0] if len(made_for) == 1 else F.explode(F.array(*made_for))).alias("r")).select("r.*")


def raw(spark: SparkSession, sf: str, platform: str) -> DataFrame:
    schema = {"shopify": P.SHOPIFY_NODE, "magento": P.MAGENTO_ITEM, "woocommerce": P.WOO_ITEM, "bigcommerce": P.BIGCOMMERCE_ITEM, "unicommerce": P.SNAPSHOT}[platform]
    return P.scan_raw_replay(bronze(spark, sf, platform), platform, schema)


def flat(products: DataFrame, *more: str) -> DataFrame:
    first = F.get("variants", 0)
    return products.select(
        "sourceId", "cleanedTitle", "normalizedBrand", "category", "sku", "status", first["variantId"].alias("variantId"), first["price"].alias("price"), first["compareAtPrice"].alias("compareAtPrice"),
        first["inventoryQty"].alias("quantity"), first["isInStock"].alias("isInStock"), F.size("images").alias("n_images"), F.size("variants").alias("n_variants"), "updatedAt", *more,
    )


#: How a platform wraps the payloads of a page: what stands before, between (as a format of each) and behind.
PAGES = {
    "shopify": ('{"data":{"products":{"edges":[', '{"node":%s}', "]}}}"),
    "magento": ('{"products":{"items":[', "%s", "]}}"),
    "woocommerce": ('{"products":[', "%s", "]}"),
    "bigcommerce": ('{"brandsAPI":{"data":[{"id":1,"name":"One"},{"id":2,"name":"Two"}]},"productsAPI":{"data":[', "%s", "]}}"),
    "unicommerce": ('{"inventoryAPI":{"inventorySnapshots":[', "%s", "]}}"),
}


def landed(spark: SparkSession, sf: str, platform: str, size: int = 50) -> str:
    """A folder of landed pages of ``size`` payloads, a line each."""
    before, each, behind = PAGES[platform]
    rows = bronze(spark, sf, platform)
    page = F.floor(F.col("sourceId").cast("long") / size).alias("page")
    joined = F.array_join(F.collect_list(F.format_string(each, "payload")), ",")
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    rows.groupBy(page).agg(F.concat(F.lit(before), joined, F.lit(behind)).alias("value")).select("value").write.text(path)
    return path


def scan_shopify(spark, sf):
    return P.scan_shopify(spark, landed(spark, sf, "shopify")).select("id", "vendor", F.size("variants.edges").alias("n_variants"))


def scan_magento(spark, sf):
    return P.scan_magento(spark, landed(spark, sf, "magento")).select("id", "name", "price")


def scan_woocommerce(spark, sf):
    return P.scan_woocommerce(spark, landed(spark, sf, "woocommerce")).select("id", "name", "stock_status")


def scan_bigcommerce(spark, sf):
    return P.scan_bigcommerce(spark, landed(spark, sf, "bigcommerce")).select("id", "name", "brand_name")


def scan_unicommerce(spark, sf):
    return P.scan_unicommerce(spark, landed(spark, sf, "unicommerce")).select("itemTypeSKU", "inventory")


def join_brand_lookup(spark, sf):
    return P.join_brand_lookup(raw(spark, sf, "bigcommerce"), brands(spark)).select("id", "brand_name")


def scan_sitemap(spark, sf):
    """The pages' URLs by way of sitemap files."""
    urls = table(spark, sf, "pages").select(F.floor(F.col("page_id") / 40).alias("file"), F.regexp_replace("url", "&", "&amp;").alias("url"))
    maps = urls.groupBy("file").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.format_string("<url><loc>%s</loc></url>", "url")), ""), F.lit("</urlset>")).alias("value"))
    path = f"{shared_folder(spark)}/sitemaps-{uuid.uuid4().hex}"
    maps.select("value").write.text(path)
    return P.scan_sitemap(spark, path).select(F.regexp_replace("url", "&amp;", "&").alias("url"))


def brands(spark: SparkSession) -> DataFrame:
    """Names of the first twenty brand ids."""
    return spark.range(20).select(F.col("id").alias("brand_id"), F.concat(F.lit("House "), F.col("id").cast("string")).alias("brand_name"))


def scan_raw_replay(spark, sf):
    return raw(spark, sf, "shopify").select("id", "vendor", F.size("variants.edges").alias("n_variants"))


def scan_incremental(spark, sf):
    return P.scan_incremental(raw(spark, sf, "magento"), [F.col("updated_at")], "2024-01-03 12:00:00").select("id", "updated_at")


def norm_shopify_products(spark, sf):
    return flat(N.norm_shopify_products(raw(spark, sf, "shopify"), "s1"))


def norm_magento_products(spark, sf):
    return flat(N.norm_magento_products(raw(spark, sf, "magento"), "s2", BASE_URL), F.map_keys("attributes").cast("string").alias("keys"))


def norm_woo_products(spark, sf):
    return flat(N.norm_woo_products(raw(spark, sf, "woocommerce"), "s3"), "description", F.col("attributes")["Size"].alias("size"))


def norm_bigcommerce_products(spark, sf):
    items = P.join_brand_lookup(raw(spark, sf, "bigcommerce"), brands(spark))
    return flat(N.norm_bigcommerce_products(items, "s4"), F.array_join("tags", ",").alias("tags"), F.get("variants", 0)["title"].alias("variantTitle"))


def norm_inventory(spark, sf):
    return N.norm_inventory(raw(spark, sf, "unicommerce"), "s5")


def offers_from_variants(spark, sf):
    return N.offers_from_variants(N.norm_shopify_products(raw(spark, sf, "shopify"), "s1")).drop("productId")


def offers_woo(spark, sf):
    return N.offers_woo(raw(spark, sf, "woocommerce"), "s3")


def join_inventory_sku(spark, sf):
    patched = N.join_inventory_sku(views.offers(spark, sf), N.norm_inventory(raw(spark, sf, "unicommerce"), "s5").where("facilityCode <> 'f0'"))
    return patched.select("id", "availability", "isInStock", "matched")


def anti_unmatched_inventory(spark, sf):
    return N.anti_unmatched_inventory(N.norm_inventory(raw(spark, sf, "unicommerce"), "s5"), views.offers(spark, sf).where("stockQty > 25")).select("sku")


QUERIES = {
    f.__name__: f
    for f in (
        scan_shopify, scan_magento, scan_woocommerce, scan_bigcommerce, scan_unicommerce, scan_sitemap, join_brand_lookup, scan_raw_replay, scan_incremental, norm_shopify_products, norm_magento_products, norm_woo_products, norm_bigcommerce_products, norm_inventory,
        offers_from_variants, offers_woo, join_inventory_sku, anti_unmatched_inventory,
    )
}

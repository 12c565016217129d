"""Platform payloads as products of one schema, and the offers that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import exprs as X

DEFAULT_CURRENCY = "INR"
#: Magento attributes that are no product attributes (fixed values).
MAGENTO_SKIPPED = ["description", "brand", "url_key", "category", "image", "small_image", "thumbnail"]
WOO_STATUS = {"publish": "active", "draft": "draft", "private": "inactive", "trash": "archived"}


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(title, "<[^>]+>", ""), "[®™©]", ""), r"\s+", " "))


def variant(id: Column, sku: Column, price: Column, compare: Column, currency: Column, quantity: Column, stocked: Column, title: Column | None = None) -> Column:
    return F.struct(
        id.alias("variantId"), (title if title is not None else F.lit(None).cast("string")).alias("title"), sku.alias("sku"), price.cast("double").alias("price"),
        compare.cast("double").alias("compareAtPrice"), currency.alias("currency"), quantity.cast("double").alias("inventoryQty"), stocked.alias("isInStock"),
    )


def image(url: Column, alt: Column, position: Column) -> Column:
    return F.struct(F.trim(url).alias("url"), X.blank_to_null(alt).alias("altText"), position.cast("int").alias("position"))


def with_url(images: Column) -> Column:
    return F.filter(images, lambda i: F.coalesce(i["url"], F.lit("")) != "")


def product(rows: DataFrame, source: str, store_id: Column, **fields: Column) -> DataFrame:
    """Rows of the product schema, with ids made of what identifies a row."""
    title, brand = fields.pop("title"), fields.pop("brand")
    made = {
        "sourceId": fields.pop("sourceId"), "source": F.lit(source), "storeId": store_id, "title": F.coalesce(title, F.lit("")), "brand": brand,
        **fields, "cleanedTitle": clean_title(F.coalesce(title, F.lit(""))), "normalizedBrand": X.brand_normalize(brand),
    }
    found = rows.select(*[column.alias(name) for name, column in made.items()])
    return found.withColumn("id", F.sha2(F.concat_ws("|", "source", "storeId", "sourceId"), 256))


def norm_shopify_products(nodes: DataFrame, store_id: str) -> DataFrame:
    currency = F.coalesce("priceRangeV2.minVariantPrice.currencyCode", F.lit(DEFAULT_CURRENCY))

    def one(e: Column) -> Column:
        n = e["node"]
        price, compare = F.coalesce(X.parse_float(n["price"]), F.lit(0.0)), X.parse_float(n["compareAtPrice"])
        quantity = n["inventoryQuantity"]
        return variant(n["id"], X.blank_to_null(n["sku"]), price, F.when(compare != price, compare), currency, quantity, F.coalesce(quantity, F.lit(0)) > 0)

    edges = F.filter("variants.edges", lambda e: e["node"].isNotNull())
    pictures = F.transform("media.edges", lambda e, i: image(e["node"]["preview"]["image"]["url"], F.lit(None).cast("string"), i))
    return product(
        nodes, "shopify", F.lit(store_id), sourceId=F.col("id"), title=F.col("title"), brand=X.blank_to_null(F.col("vendor")),
        category=X.blank_to_null(F.col("productType")), description=X.blank_to_null(F.col("description")), sku=X.blank_to_null(F.get(edges, 0)["node"]["sku"]),
        status=F.lower("status"), tags=F.coalesce("tags", F.array().cast("array<string>")), images=with_url(pictures), variants=F.transform(edges, one),
        updatedAt=F.try_to_timestamp("updatedAt"),
    )


def _attribute(code: str) -> Column:
    return X.blank_to_null(F.get(F.filter("custom_attributes", lambda a: a["attribute_code"] == code), 0)["value"])


def norm_magento_products(items: DataFrame, store_id: str, base_url: str, currency: str = DEFAULT_CURRENCY) -> DataFrame:
    stock = F.col("extension_attributes.stock_item")
    sku = X.blank_to_null(F.col("sku"))
    shown = F.filter("media_gallery_entries", lambda e: ~F.coalesce(e["disabled"], F.lit(False)))
    place = lambda f: F.when(f.startswith("http"), f).otherwise(F.concat(F.lit(base_url.rstrip("/") + "/pub/media/catalog/product"), f))
    pictures = F.transform(shown, lambda e: image(place(e["file"]), e["label"], e["position"]))
    kept = F.filter("custom_attributes", lambda a: ~a["attribute_code"].isin(MAGENTO_SKIPPED) & X.blank_to_null(a["value"]).isNotNull())
    return product(
        items, "magento", F.lit(store_id), sourceId=F.col("id").cast("string"), title=F.col("name"), brand=_attribute("brand"), category=_attribute("category"),
        description=_attribute("description"), sku=sku, status=F.when(F.col("status") == 1, "active").when(F.col("status") == 2, "inactive"),
        images=with_url(pictures), attributes=X.last_wins(F.transform(kept, lambda a: F.struct(a["attribute_code"].alias("k"), F.trim(a["value"]).alias("v")))),
        variants=F.array(variant(sku, sku, F.col("price"), F.lit(None), F.lit(currency), stock["qty"], F.coalesce(stock["is_in_stock"], F.lit(False)))),
        updatedAt=F.try_to_timestamp("updated_at"),
    )


def norm_woo_products(items: DataFrame, store_id: str) -> DataFrame:
    is_brand = lambda a: (F.lower(F.coalesce(a["name"], F.lit(""))) == "brand") | (F.lower(F.coalesce(a["slug"], F.lit(""))) == "pa_brand")
    by_attribute = F.get(F.get(F.filter("attributes", is_brand), 0)["options"], 0)
    brand = X.blank_to_null(F.when(F.size(F.coalesce("brands", F.array().cast("array<struct<name:string>>"))) > 0, F.get("brands", 0)["name"]).otherwise(by_attribute))
    sku, key = X.blank_to_null(F.col("sku")), F.col("id").cast("string")
    others = F.filter("attributes", lambda a: ~is_brand(a) & a["name"].isNotNull() & (F.size(a["options"]) > 0))
    pictures = F.transform("images", lambda i, n: image(i["src"], i["alt"], n))
    own = variant(
        F.coalesce(sku, key), sku, F.coalesce(X.parse_float(F.col("price")), F.lit(0.0)), F.when(F.col("on_sale"), X.parse_float(F.col("regular_price"))),
        F.lit(DEFAULT_CURRENCY), F.when(F.col("manage_stock"), F.col("stock_quantity")), F.col("stock_status") == "instock",
    )
    return product(
        items, "woocommerce", F.lit(store_id), sourceId=key, title=F.col("name"), brand=brand, category=F.get("categories", 0)["name"],
        description=X.blank_to_null(F.regexp_replace("description", "<[^>]*>", "")), sku=sku, status=F.try_element_at(X.literal_map(WOO_STATUS), F.col("status")),
        images=with_url(pictures), attributes=X.last_wins(F.transform(others, lambda a: F.struct(a["name"].alias("k"), F.array_join(a["options"], ", ").alias("v")))),
        variants=F.array(own), categoryIds=F.transform("categories", lambda c: c["id"].cast("string")), updatedAt=F.try_to_timestamp("date_modified"),
    )


def norm_bigcommerce_products(items: DataFrame, store_id: str) -> DataFrame:
    sku, key = X.blank_to_null(F.col("sku")), F.col("id").cast("string")

    def one(v: Column) -> Column:
        price = F.coalesce(v["price"], F.col("price"), F.lit(0.0))
        options = F.array_join(F.transform(v["option_values"], lambda o: o["label"]), " / ")
        return variant(
            v["id"].cast("string"), X.blank_to_null(v["sku"]), price, F.when(v["retail_price"] != price, v["retail_price"]), F.lit(DEFAULT_CURRENCY),
            v["inventory_level"], F.coalesce(v["inventory_level"], F.lit(0)) > 0, X.blank_to_null(options),
        )

    single = variant(
        F.coalesce(sku, key), sku, F.coalesce("price", F.lit(0.0)), F.lit(None), F.lit(DEFAULT_CURRENCY), F.col("inventory_level"), F.coalesce("inventory_level", F.lit(0)) > 0
    )
    urls = F.array_distinct(F.filter(F.concat(
        F.array("primary_image.url_standard"), F.coalesce(F.transform("images", lambda i: F.coalesce(i["url_standard"], i["url_zoom"])), F.array().cast("array<string>")),
        F.coalesce(F.transform("variants", lambda v: v["image_url"]), F.array().cast("array<string>")),
    ), lambda u: F.coalesce(F.trim(u), F.lit("")) != ""))
    status = F.when(F.col("availability") == "preorder", "preorder").when(~F.col("is_visible"), "inactive").otherwise("active")
    tags = F.filter(F.transform(F.split(F.coalesce("search_keywords", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    fields = F.filter("custom_fields", lambda f: ~F.lower(f["name"]).isin("brand", "description") & (F.trim(f["name"]) != "") & (F.trim(f["value"]) != ""))
    return product(
        items, "bigcommerce", F.lit(store_id), sourceId=key, title=F.col("name"), brand=X.blank_to_null(F.col("brand_name")), category=F.lit(None).cast("string"),
        description=X.blank_to_null(F.regexp_replace("description", "<[^>]*>", "")), sku=sku, status=status, tags=tags,
        images=F.transform(urls, lambda u, i: image(u, F.lit(None).cast("string"), i)), attributes=X.last_wins(F.transform(fields, lambda f: F.struct(F.trim(f["name"]).alias("k"), F.trim(f["value"]).alias("v")))),
        variants=F.when(F.size("variants") > 0, F.transform("variants", one)).otherwise(F.array(single)), categoryIds=F.transform("categories", lambda c: c.cast("string")),
        updatedAt=F.try_to_timestamp("date_modified"),
    )


def norm_inventory(snapshots: DataFrame, store_id: str, threshold: int = 10) -> DataFrame:
    """Stock patches by SKU; what is blocked isn't available."""
    total, blocked = (F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0)) for c in ("inventory", "blockedInventory"))
    available = F.greatest(F.lit(0.0), total - blocked)
    return snapshots.select(
        F.col("itemTypeSKU").alias("sku"), "facilityCode", available.alias("availableInventory"), total.alias("totalInventory"), blocked.alias("blockedInventory"),
        X.availability_inventory(available, threshold).alias("availability"), (available > 0).alias("isInStock"), F.lit(store_id).alias("storeId"),
    )


def offers_from_variants(products: DataFrame) -> DataFrame:
    """One offer per variant."""
    v = products.select("id", "source", "storeId", F.explode("variants").alias("v"))
    stocked = F.when(F.col("v.inventoryQty").isNotNull(), F.col("v.inventoryQty") > 0).otherwise(F.col("v.isInStock"))
    return v.select(
        F.col("id").alias("productId"), "source", "storeId", "v.variantId", "v.sku", "v.price", "v.compareAtPrice", "v.currency",
        F.when(stocked, "in_stock").otherwise("out_of_stock").alias("availability"), stocked.alias("isInStock"),
    )


def offers_woo(items: DataFrame, store_id: str, threshold: int = 10) -> DataFrame:
    """One offer per item with its discount while on sale."""
    regular, sale = X.parse_float(F.col("regular_price")), X.parse_float(F.col("sale_price"))
    off = F.when(F.col("on_sale") & (regular > 0), F.round((regular - sale) / regular * 100, 2))
    quantity = F.when(F.col("manage_stock"), F.col("stock_quantity"))
    return items.select(
        F.col("id").cast("string").alias("sourceId"), F.lit(store_id).alias("storeId"), F.coalesce(X.blank_to_null(F.col("sku")), F.col("id").cast("string")).alias("variantId"),
        F.coalesce(X.parse_float(F.col("price")), F.lit(0.0)).alias("price"), off.alias("discountPercent"), X.availability_woo(quantity, F.col("stock_status"), threshold).alias("availability"),
    )


def join_inventory_sku(offers: DataFrame, patches: DataFrame) -> DataFrame:
    """Offers with the stock of their SKU's patch, where there is one; of several the fullest."""
    best = patches.groupBy("sku").agg(F.max(F.struct("availableInventory", "availability", "isInStock")).alias("p"))
    joined = offers.join(best, "sku", "left")
    return joined.withColumns({
        "availability": F.coalesce("p.availability", "availability"), "isInStock": F.coalesce("p.isInStock", "isInStock"), "matched": F.col("p").isNotNull(),
    }).drop("p")


#: What an inventory patch may set.
INVENTORY_FIELDS = (
    "availability", "stockQty", "isInStock", "availableInventory", "totalInventory", "blockedInventory", "facilityCode", "inventorySource", "lastSyncedAt",
)


def patch_inventory(offers: DataFrame, patches: DataFrame) -> DataFrame:
    """Offers after all patches of their SKU, with ``matched`` and ``modified``.

    ``patches``: sku, storeId (null: all stores), seq (their order) and any of INVENTORY_FIELDS; a null field sets nothing.
    Of the patches that fit an offer, the last one that sets a field decides it. Patches are brought to one row for each
    SKU and store before they meet offers, so the joins don't multiply rows; patches without a SKU fit none.
    """
    fields = [f for f in INVENTORY_FIELDS if f in patches.columns]
    value = lambda f: F.struct("seq", F.col(f).alias("v"))
    last = patches.where("sku is not null").groupBy("sku", "storeId").agg(F.count("*").alias("n"), *[F.max_by(value(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])
    side = lambda rows, name, keys: rows.select(*keys, F.struct("n", *fields).alias(name))
    own, all_stores = side(last.where("storeId is not null"), "own", ["sku", "storeId"]), side(last.where("storeId is null"), "every", ["sku"])
    joined = offers.join(own, ["sku", "storeId"], "left").join(all_stores, "sku", "left")
    held = lambda f: F.col(f) if f in offers.columns else F.lit(None).cast(patches.schema[f].dataType)

    def after(f: str):
        a, b = F.col(f"own.{f}"), F.col(f"every.{f}")
        return F.coalesce(F.when(a["seq"] > F.coalesce(b["seq"], a["seq"] - 1), a["v"]).otherwise(b["v"]), held(f))

    kept = [F.col(c) for c in offers.columns if c not in fields]
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~after(f).eqNullSafe(held(f))
    return joined.select(*kept, *[after(f).alias(f) for f in fields], (F.col("own").isNotNull() | F.col("every").isNotNull()).alias("matched"), changed.alias("modified"))


def inventory_matches(patches: DataFrame, offers: DataFrame, variants: DataFrame, parts: int = 1) -> DataFrame:
    """Each patch (sku, storeId, seq) with the offers and products it fits; ``variants``: productId, storeId, sku of products.

    Offers and variants are counted by SKU and store first; a patch without a store adds its SKU's counts over stores.
    With many offers, ``parts`` says into how many parts these are dealt.
    """
    ones = lambda rows, o: rows.where("sku is not null").select("sku", "storeId", F.lit(o).alias("o"), F.lit(1 - o).alias("p"))
    rows = ones(offers, 1).unionByName(ones(variants.distinct(), 0))
    dealt = lambda df: df.repartition(parts, "sku", "storeId") if parts > 1 else df
    by_store = dealt(rows).groupBy("sku", "storeId").agg(F.sum("o").alias("o"), F.sum("p").alias("p"))
    total = by_store.groupBy("sku").agg(F.sum("o").alias("to"), F.sum("p").alias("tp"))
    joined = dealt(patches.select("seq", "sku", "storeId")).join(by_store, ["sku", "storeId"], "left").join(total, "sku", "left")
    pick = lambda own, every: F.coalesce(F.when(F.col("storeId").isNull(), F.col(every)).otherwise(F.col(own)), F.lit(0).cast("long"))
    return joined.select("seq", "sku", "storeId", pick("o", "to").alias("offersMatched"), pick("p", "tp").alias("productsMatched"))


def anti_unmatched_inventory(patches: DataFrame, offers: DataFrame) -> DataFrame:
    """Patches without an offer of their SKU."""
    return patches.join(offers.select("sku"), "sku", "left_anti")


def offers_magento(products: DataFrame, threshold: int = 10) -> DataFrame:
    """One offer per product, its variant the SKU."""
    v = F.get("variants", 0)
    quantity = v["inventoryQty"]
    return products.where(v["variantId"].isNotNull()).select(
        F.col("sourceId"), "storeId", v["variantId"].alias("variantId"), v["price"].alias("price"), v["currency"].alias("currency"),
        X.availability_threshold(quantity, threshold).alias("availability"), quantity.alias("stockQty"),
    )


def offers_bigcommerce(items: DataFrame, store_id: str, threshold: int = 10) -> DataFrame:
    """One offer per item: stock by its tracking mode, the sale price if there is one, discount against retail."""
    first = F.get("variants", 0)["inventory_level"]
    quantity = F.when(F.col("inventory_tracking") == "none", None).when(F.col("inventory_tracking") == "variant", F.coalesce(first, "inventory_level")).otherwise(F.col("inventory_level"))
    price = F.when(F.col("sale_price") > 0, F.col("sale_price")).otherwise(F.coalesce("price", F.lit(0.0)))
    off = F.when(F.col("retail_price") > price, F.round((F.col("retail_price") - price) / F.col("retail_price") * 100, 2))
    return items.select(
        F.col("id").cast("string").alias("sourceId"), F.lit(store_id).alias("storeId"), price.alias("price"), off.alias("discountPercent"),
        quantity.alias("stockQty"), X.availability_threshold(quantity, threshold).alias("availability"),
    )


def norm_webhook_rest(events: DataFrame) -> DataFrame:
    """REST-shaped product events (id, title, vendor, tags, presentment currency) as product nodes."""
    gid = lambda c: F.when(c.startswith("gid://"), c).otherwise(F.concat(F.lit("gid://shopify/Product/"), c))
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return events.select(gid(F.col("id")).alias("id"), "title", "vendor", tags.alias("tags"), F.coalesce("currency", F.lit(DEFAULT_CURRENCY)).alias("currencyCode"))


#: What is read of a REST-shaped product event; numbers and texts alike are read as texts.
REST_PRODUCT = """id string, title string, body_html string, vendor string, product_type string, status string, tags string, created_at string,
    updated_at string, images array<struct<src: string>>, variants array<struct<id: string, sku: string, price: string, compare_at_price: string,
    inventory_quantity: string, inventory_item_id: string, presentment_prices: array<struct<price: struct<currency_code: string>>>>>"""


def norm_webhook_payload(events: DataFrame, payload: str = "payload") -> DataFrame:
    """REST-shaped product events (JSON text) as whole product nodes; other columns are carried along.

    Ids without a scheme get one, for products and variants; blank texts are null, a missing title is ''. Tags come as a
    list or as a text with commas. A quantity that is no plain whole number is null. The currency is that of the first
    variant's first presentment price, else the default. A payload that is no JSON object gives nulls, '' and empty lists.
    """
    gid = lambda kind, c: F.when(c.startswith("gid://"), c).otherwise(F.concat(F.lit(f"gid://shopify/{kind}/"), c))
    filled = lambda c: F.nullif(c, F.lit(""))
    p = F.from_json(payload, REST_PRODUCT)
    listed = F.when(F.col("p.tags").startswith("["), F.from_json("p.tags", "array<string>"))
    cut = F.filter(F.transform(F.split("p.tags", ","), lambda t: F.trim(t)), lambda t: t != "")
    node = lambda v: F.struct(
        gid("ProductVariant", v["id"]).alias("id"), filled(v["sku"]).alias("sku"), v["price"].alias("price"), v["compare_at_price"].alias("compareAtPrice"),
        v["inventory_quantity"].try_cast("long").alias("inventoryQuantity"), v["inventory_item_id"].alias("inventoryItemId"),
    )
    none = F.array().cast("array<string>")
    currency = F.get(F.get(F.col("p.variants"), F.lit(0))["presentment_prices"], F.lit(0))["price"]["currency_code"]
    return events.withColumn("p", p).select(
        *[c for c in events.columns if c != payload], gid("Product", F.col("p.id")).alias("id"), F.coalesce("p.title", F.lit("")).alias("title"),
        filled(F.col("p.body_html")).alias("description"), filled(F.col("p.vendor")).alias("vendor"), filled(F.col("p.product_type")).alias("productType"),
        filled(F.col("p.status")).alias("status"), F.coalesce(listed, cut, none).alias("tags"), filled(F.col("p.created_at")).alias("createdAt"),
        filled(F.col("p.updated_at")).alias("updatedAt"), F.coalesce(F.transform("p.variants", node), F.array()).alias("variants"),
        F.coalesce(F.transform("p.images", lambda m: filled(m["src"])), none).alias("images"), F.coalesce(filled(currency), F.lit(DEFAULT_CURRENCY)).alias("currencyCode"),
    )


def norm_scraped(extracted: DataFrame) -> DataFrame:
    """Extracted pages as products with one variant; currency USD unless the page says otherwise."""
    price = F.coalesce("price", F.lit(0.0))
    currency = F.coalesce("currency", F.lit("USD"))
    key = F.col("page_id").cast("string")
    none = F.lit(None).cast("string")
    one = variant(key, none, price, none, currency, none, F.lit(True))
    return product(extracted, "scraped", F.lit("web"), sourceId=key, title=F.col("title"), brand=X.blank_to_null(F.col("brand")), status=F.lit("active"), variants=F.array(one))


def join_inventory_item(events: DataFrame, variants: DataFrame, fallback: DataFrame) -> DataFrame:
    """Inventory events (item) with the SKU of the item among archived variants (item, sku), else among products'."""
    one = lambda df, name: df.groupBy("item").agg(F.min("sku").alias(name))
    joined = events.join(one(variants, "first"), "item", "left").join(one(fallback, "second"), "item", "left")
    return joined.withColumn("sku", F.coalesce("first", "second")).drop("first", "second")

"""Column expressions of the catalog: text, price, availability and identity rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
ABBREVIATIONS = {
    "qty": "quantity",
    "pcs": "pieces",
    "ml": "milliliter",
    "kg": "kilogram",
    "g": "gram",
    "l": "liter",
    "sz": "size",
    "col": "color",
    "blk": "black",
    "wht": "white",
    "rd": "red",
}
FILLERS = ["buy", "online", "india", "free", "shipping", "offer", "best", "price", "new", "latest", "original"]
SOURCE_PRIORITY = {"shopify": 1, "magento": 2, "woocommerce": 3, "bigcommerce": 4, "unicommerce": 5, "scraped": 6}
UNKNOWN_PRIORITY = 99
#: Availability values that count as in stock, by the job that asks.
SUMMARY_IN_STOCK = ["in_stock", "limited", "limited_stock"]
PRODUCT_IN_STOCK = ["in_stock", "limited"]
QUALITY_IN_STOCK = ["inStock", "in_stock"]
#: Phrases of availability texts, in the order in which they count.
IN_STOCK_PHRASES = ["in stock", "instock", "in-stock", "available", "ships immediately", "add to cart"]
OUT_OF_STOCK_PHRASES = ["out of stock", "outofstock", "sold out", "unavailable", "not available"]
LIMITED_PHRASES = ["only", "limited stock", "few left", "hurry", "low stock"]
#: Titles and descriptions with these are no product's.
GENERIC_PHRASES = ["official website", "home page", "visit now", "home", "homepage", "welcome", "all rights reserved"]
#: URLs of product pages, and parts that no such URL has.
PRODUCT_URL = "/(product|products|p|item|dp)/"
NO_PRODUCT_MARKS = ["/reviews", "/blog", "/blogs", "/collection", "/collections", "/search", "/cart", "/account", "?id="]
#: Texts of links to a next page.
NEXT_TEXT = "next|\u2192|\u00bb|>"
#: Character entities; the ampersand is the last to be replaced.
ENTITIES = {"&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def last_wins(entries: Column) -> Column:
    """A map of the entries (k, v); of equal keys the last one counts, null keys don't."""
    named = F.filter(entries, lambda e: e["k"].isNotNull())
    later = lambda e, i: F.exists(F.slice(named, i + 2, F.size(named)), lambda o: o["k"] == e["k"])
    return F.map_from_entries(F.filter(named, lambda e, i: ~later(e, i)))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def text_normalize(text: Column) -> Column:
    """Lower case, punctuation to spaces, abbreviations spelled out, filler words dropped; '' for null."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s-]", " ")
    words = literal_map(ABBREVIATIONS)
    spelled = lambda part: F.coalesce(F.try_element_at(words, part), part)
    wanted = lambda part: (part != "") & ~part.isin(FILLERS)
    token = lambda t: F.array_join(F.filter(F.transform(F.split(t, "-"), spelled), wanted), "-")
    return F.array_join(F.filter(F.transform(F.split(cleaned, r"\s+"), token), lambda t: t != ""), " ")


def brand_normalize(brand: Column) -> Column:
    return blank_to_null(F.lower(brand))


def canonical_id(title: Column, brand: Column) -> Column:
    """Content hash of the normalised title and brand; null for a blank title."""
    name = text_normalize(title)
    digest = F.sha2(F.concat(name, F.lit("|"), F.coalesce(brand_normalize(brand), F.lit(""))), 256)
    return F.when(name != "", F.concat(F.lit("cprod_"), F.substring(digest, 1, 24)))


def store_id_hash(domain: Column) -> Column:
    return F.concat(F.lit("store_"), F.substring(F.sha2(domain, 256), 1, 16))


def char_histogram(text: Column) -> Column:
    """Count of each character but white space, a map."""
    chars = F.filter(F.split(F.regexp_replace(text, r"\s+", ""), ""), lambda c: c != "")
    kinds = F.array_distinct(chars)
    count = lambda c: F.size(F.filter(chars, lambda x: x == c))
    return F.map_from_arrays(kinds, F.transform(kinds, count))


def histogram_similarity(a: Column, b: Column) -> Column:
    """Shared characters over the longer length, from two histograms; 0 if either is empty."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda acc, n: acc + n)
    both = F.map_zip_with(a, b, lambda _, x, y: F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))
    longest = F.greatest(total(a), total(b))
    shared = total(both)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / longest).otherwise(0.0)


def brand_match(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), 0.5).when(a == b, 1.0).otherwise(0.0)


def category_match(a: Column, b: Column) -> Column:
    """Of normalised categories, '' for none."""
    return F.when((a == "") | (b == ""), 0.5).when(a == b, 1.0).otherwise(0.0)


def price_gap(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b), F.greatest(a, b))


def dedup_score(title: Column, brand: Column, category: Column, pa: Column, pb: Column) -> Column:
    """Weighted similarity of two products; a price gap over 30 % makes it 0."""
    gap = price_gap(pa, pb)
    near = F.when(pa.isNull() | pb.isNull(), 0.5).when(F.greatest(pa, pb) > 0, 1 - gap).otherwise(0.0)
    score = title * 0.40 + brand * 0.20 + F.greatest(F.lit(0.0), near) * 0.30 + category * 0.10
    return F.when((pa != 0) & (pb != 0) & (gap > 0.30), 0.0).otherwise(F.least(F.lit(1.0), score))


def attribute_text(value: Column) -> Column:
    """An attribute's value without units and spaces."""
    split = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), "([0-9])([a-zA-Z])", "$1 $2"))
    bare = F.regexp_replace(split, r"\b(milliliter|liter|kilogram|gram|pieces|quantity|size)\b", "")
    return F.regexp_replace(bare, r"\s+", "")


def attribute_similarity(a: Column, b: Column) -> Column:
    """Share of common keys with equal values; 0.5 without a common key."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    same = F.filter(common, lambda k: (attribute_text(a[k]) != "") & (attribute_text(a[k]) == attribute_text(b[k])))
    return F.when(F.size(common) > 0, F.size(same) / F.size(common)).otherwise(0.5)


def entity_score(title: Column, brand: Column, category: Column, attributes: Column, pa: Column, pb: Column, sa: Column, sb: Column) -> Column:
    """Price gate, then equal SKUs, then the weighted sum, capped for different SKUs."""
    gap = F.when(F.greatest(pa, pb) > 0, price_gap(pa, pb)).otherwise(0.0)
    known = pa.isNotNull() & pb.isNotNull()
    near = F.when(known, F.greatest(F.lit(0.0), 1 - gap)).otherwise(0.5)
    base = title * 0.35 + brand * 0.2 + near * 0.25 + category * 0.1 + attributes * 0.1
    both = blank_to_null(sa).isNotNull() & blank_to_null(sb).isNotNull()
    return (
        F.when(known & (gap > 0.3), 0.0)
        .when(both & (F.trim(sa) == F.trim(sb)), 1.0)
        .when(both, F.least(F.lit(0.7), base))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)))
    )


def availability_threshold(quantity: Column, threshold: Column | int = 10) -> Column:
    limit = F.lit(threshold) if isinstance(threshold, int) else threshold
    return F.when(quantity.isNull(), "in_stock").when(quantity == 0, "out_of_stock").when(quantity <= limit, "limited").otherwise("in_stock")


def availability_woo(quantity: Column, status: Column, threshold: int = 10) -> Column:
    return (
        F.when(status == "outofstock", "out_of_stock").when(status == "onbackorder", "on_backorder")
        .when(quantity <= threshold, "limited").otherwise("in_stock")
    )


def availability_inventory(quantity: Column, threshold: Column | int = 10) -> Column:
    limit = F.lit(threshold) if isinstance(threshold, int) else threshold
    return F.when(quantity <= 0, "out_of_stock").when(quantity <= limit, "limited").otherwise("in_stock")


def discount_percent(original: Column, price: Column) -> Column:
    return F.when(original > price, F.round((original - price) / original * 100))


def price_per_unit(price: Column, quantity: Column) -> Column:
    return F.try_divide(price, F.nullif(quantity, F.lit(0.0)))


def parse_float(text: Column) -> Column:
    """The number that a text begins with, else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1), F.lit("")).cast("double")


def price_normalize(text: Column) -> Column:
    """Amount and ISO currency of a price text; the amount is null without a number, the currency USD without a mark."""
    currency = (
        F.when(text.rlike(r"(?i)INR|RS|RUPEE|₹"), "INR").when(text.rlike(r"(?i)USD|\$"), "USD")
        .when(text.rlike(r"(?i)EUR|€"), "EUR").when(text.rlike(r"(?i)GBP|£"), "GBP").otherwise("USD")
    )
    amount = F.nullif(F.regexp_extract(F.regexp_replace(text, ",", ""), r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    return F.struct(amount.alias("amount"), currency.alias("currency"))


def availability_normalize(text: Column) -> Column:
    """in_stock, out_of_stock, limited_stock or unknown, by the first kind of phrase that a text holds."""
    said = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    holds = lambda phrases: said.rlike("|".join(phrases))
    state = F.when(holds(IN_STOCK_PHRASES), "in_stock").when(holds(OUT_OF_STOCK_PHRASES), "out_of_stock").when(holds(LIMITED_PHRASES), "limited_stock")
    return state.otherwise("unknown")


def is_product_url(url: Column) -> Column:
    """Whether a URL looks like a product page."""
    lower = F.lower(F.coalesce(url, F.lit("")))
    excluded = F.lit(False)
    for mark in NO_PRODUCT_MARKS:
        excluded = excluded | F.contains(lower, F.lit(mark))
    return lower.rlike(PRODUCT_URL) & ~excluded


def unescape(text: Column) -> Column:
    """``text`` with the common character entities as characters."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def variant_signature(variants: Column) -> Column:
    """The sorted words for what variants differ in (title, option names and values, attribute values), else null."""
    plain = lambda c: F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " ")), "[^a-z0-9]+", " ")), " ", "_")
    said = F.flatten(F.transform(variants, lambda v: F.concat(
        F.array(v["title"]), F.flatten(F.transform(F.coalesce(v["options"], F.array().cast("array<struct<name:string,value:string>>")), lambda o: F.array(o["name"], o["value"]))),
        F.map_values(F.coalesce(v["attributes"], F.create_map().cast("map<string,string>"))),
    )))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(said, plain), lambda t: t != ""))), "_"), F.lit(""))


def price_range(variants: Column) -> Column:
    """min, max and currency over the prices of variants; nulls without a price."""
    prices = F.filter(F.transform(variants, lambda v: v["price"]), lambda p: p.isNotNull() & ~F.isnan(p))
    named = F.filter(F.transform(variants, lambda v: blank_to_null(v["currency"])), lambda c: c.isNotNull())
    has = F.size(prices) > 0
    return F.struct(
        F.when(has, F.array_min(prices)).alias("min"), F.when(has, F.array_max(prices)).alias("max"), F.when(has, F.get(named, 0)).alias("currency")
    )


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " "))


def source_priority(source: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(SOURCE_PRIORITY), F.lower(source)), F.lit(UNKNOWN_PRIORITY))


def grouping_key(sku: Column, brand: Column, title: Column, signature: Column) -> Column:
    """Normalised SKU, else brand, title and the variants' signature, else brand and title; null if a part is blank."""
    plain = lambda c: blank_to_null(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    named = F.concat_ws("_", plain(brand), plain(title), signature)
    return F.coalesce(plain(sku), F.when(plain(brand).isNotNull() & plain(title).isNotNull(), named))

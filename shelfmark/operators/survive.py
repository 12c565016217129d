"""Merging of source products into canonical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import exprs as X


def first_filled(column: str, order: list[Column]) -> Column:
    """The first non-blank value of a group in the given order."""
    value = X.blank_to_null(F.col(column))
    return F.min_by(value, F.struct(value.isNull().alias("blank"), *[o.alias(f"o{i}") for i, o in enumerate(order)]))


def canonical_merge(products: DataFrame) -> DataFrame:
    """One row per canonical id: first filled title, brand, category in source-id order, union of sources, price range."""
    order = [F.col("lastSyncedAt"), F.col("id")]
    known = products.where("canonicalProductId is not null")
    return known.groupBy(F.col("canonicalProductId").alias("canonicalId")).agg(
        first_filled("title", order).alias("title"),
        first_filled("brand", order).alias("brand"),
        first_filled("category", order).alias("category"),
        first_filled("description", order).alias("description"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.count("*").alias("productCount"),
        F.min("price").alias("priceMin"),
        F.max("price").alias("priceMax"),
        F.min_by("currency", F.struct(*order)).alias("currency"),
        F.max("lastSyncedAt").alias("updatedAt"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lastSyncedAt", "id", "images"))), lambda s: s["images"]))).alias("images"),
    )


def merged_variants(products: DataFrame) -> DataFrame:
    """canonicalId and its distinct variants, in the order of their products; of equal ones the first stays.

    Variants are told apart by id, else by SKU, else by all they hold.
    """
    known = products.where("canonicalProductId is not null")
    each = known.select(F.col("canonicalProductId").alias("canonicalId"), "lastSyncedAt", "id", F.posexplode("variants").alias("n", "variant"))
    own = lambda f: X.blank_to_null(F.col(f"variant.{f}"))
    keyed = each.withColumn("key", F.coalesce(own("variantId"), own("sku"), F.to_json("variant")))
    order = F.struct("lastSyncedAt", "id", "n")
    first = keyed.groupBy("canonicalId", "key").agg(F.min(order).alias("o"), F.min_by("variant", order).alias("variant"))
    earlier = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    listed = F.array_sort(F.collect_list(F.struct("o", "variant")), earlier)
    return first.groupBy("canonicalId").agg(F.transform(listed, lambda v: v["variant"]).alias("variants"))


def merged_attributes(products: DataFrame) -> DataFrame:
    """canonicalId, key, value: per attribute the first filled value, in the order of the products."""
    known = products.where("canonicalProductId is not null")
    each = known.select(F.col("canonicalProductId").alias("canonicalId"), "lastSyncedAt", "id", F.explode("attributes").alias("key", "value"))
    order = F.struct((F.coalesce("value", F.lit("")) == "").alias("blank"), "lastSyncedAt", "id")
    return each.groupBy("canonicalId", "key").agg(F.min_by("value", order).alias("value"))


def golden_attributes(products: DataFrame) -> DataFrame:
    """canonicalId, key, value: per attribute the filled value of the best source, then the newest, the longest, the smallest id."""
    known = products.where("canonicalProductId is not null").withColumn("priority", X.source_priority(F.col("source")))
    each = known.select(F.col("canonicalProductId").alias("canonicalId"), "priority", "lastSyncedAt", "id", F.explode("attributes").alias("key", "value"))
    filled = each.withColumn("value", X.blank_to_null(F.col("value"))).where("value is not null")
    order = F.struct("priority", (-F.unix_micros("lastSyncedAt")).alias("t"), (-F.length("value")).alias("n"), "id")
    return filled.groupBy("canonicalId", "key").agg(F.min_by("value", order).alias("value"))


def golden_images(products: DataFrame) -> DataFrame:
    """canonicalId, position, url: all distinct images, those of the best sources first."""
    known = products.where("canonicalProductId is not null").withColumn("priority", X.source_priority(F.col("source")))
    each = known.select(F.col("canonicalProductId").alias("canonicalId"), "priority", "id", F.posexplode("images").alias("n", "url")).withColumn("url", X.blank_to_null(F.col("url")))
    first = each.where("url is not null").groupBy("canonicalId", "url").agg(F.min(F.struct("priority", "id", "n")).alias("o"))
    listed = first.groupBy("canonicalId").agg(F.array_sort(F.collect_list(F.struct("o", "url"))).alias("l"))
    return listed.select("canonicalId", F.posexplode("l").alias("position", "i")).select("canonicalId", "position", "i.url")


def golden_record(products: DataFrame) -> DataFrame:
    """Per canonical id and field the value that wins: filled, then source priority, recency, length, id."""
    known = products.where("canonicalProductId is not null").withColumn("priority", X.source_priority(F.col("source")))

    def winner(column: str) -> Column:
        return first_filled(column, [F.col("priority"), -F.unix_micros("lastSyncedAt"), -F.coalesce(F.length(column), F.lit(0)), F.col("id")])

    return known.groupBy(F.col("canonicalProductId").alias("canonicalId")).agg(*[winner(c).alias(c) for c in ("title", "brand", "category", "description", "sku")])


def resolve_field(existing: str, incoming: str) -> Column:
    """winner and reason for a field of two rows with priorities and times (``pe, pi, te, ti``)."""
    e, i = X.blank_to_null(F.col(existing)), X.blank_to_null(F.col(incoming))
    made = lambda w, r: F.struct(F.lit(w).alias("winner"), F.lit(r).alias("reason"))
    return (
        F.when(i.isNull(), made("existing", "null_fallback"))
        .when(e.isNull(), made("incoming", "null_fallback"))
        .when(F.col("pe") < F.col("pi"), made("existing", "source_priority"))
        .when(F.col("pi") < F.col("pe"), made("incoming", "source_priority"))
        .when(F.col("ti").isNotNull() & (F.col("te").isNull() | (F.col("ti") > F.col("te"))), made("incoming", "recency"))
        .when(F.col("te").isNotNull() & (F.col("ti").isNull() | (F.col("te") > F.col("ti"))), made("existing", "recency"))
        .when(F.length(i) > F.length(e), made("incoming", "completeness"))
        .when(F.length(e) > F.length(i), made("existing", "completeness"))
        .otherwise(made("existing", "completeness"))
    )


FIELDS = ("title", "brand", "category", "description")


def resolve_product(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Conflicts of incoming products with the existing row of their canonical id: one row per field that differs."""
    named = lambda df, s: df.select(
        F.col("canonicalProductId"), F.col("id").alias(f"id_{s}"), X.source_priority(F.col("source")).alias(f"p{s[0]}"),
        F.col("lastSyncedAt").alias(f"t{s[0]}"), *[F.col(f).alias(f"{f}_{s}") for f in FIELDS],
    )
    pairs = named(existing, "existing").join(named(incoming, "incoming"), "canonicalProductId")
    rows = [
        F.struct(F.lit(f).alias("field"), F.col(f"{f}_existing").alias("existing"), F.col(f"{f}_incoming").alias("incoming"), resolve_field(f"{f}_existing", f"{f}_incoming").alias("r"))
        for f in FIELDS
    ]
    told = pairs.select("canonicalProductId", "id_incoming", F.inline(F.array(*rows)))
    differ = ~F.coalesce(X.blank_to_null(F.col("existing")), F.lit("")).eqNullSafe(F.coalesce(X.blank_to_null(F.col("incoming")), F.lit("")))
    value = F.when(F.col("r.winner") == "incoming", F.col("incoming")).otherwise(F.col("existing"))
    return told.where(differ).select("canonicalProductId", F.col("id_incoming").alias("productId"), "field", F.col("r.winner").alias("winner"), F.col("r.reason").alias("reason"), value.alias("value"))


WHOLE_FIELDS = ("title", "cleanedTitle", "brand", "normalizedBrand", "category", "description")


def decided(pair: Column, pe: Column, pi: Column, te: Column, ti: Column) -> Column:
    """``pair`` (field, existing, incoming) with winner, reason and value, by the sides' priorities and times.

    A blank value never wins over a filled one; then the smaller priority number, the later time (a time over none),
    and the longer text decide. What is equal in all of these stays as it is.
    """
    e, i = X.blank_to_null(pair["existing"]), X.blank_to_null(pair["incoming"])
    rules = [
        (e.isNull(), "incoming", "null_fallback"),
        (i.isNull(), "existing", "null_fallback"),
        (pe < pi, "existing", "source_priority"),
        (pi < pe, "incoming", "source_priority"),
        (ti.isNotNull() & (te.isNull() | (ti > te)), "incoming", "recency"),
        (te.isNotNull() & (ti.isNull() | (te > ti)), "existing", "recency"),
        (F.length(pair["incoming"]) > F.length(pair["existing"]), "incoming", "completeness"),
        (F.lit(True), "existing", "completeness"),
    ]
    first = F.coalesce(*[F.when(rule, F.struct(F.lit(w).alias("winner"), F.lit(r).alias("reason"))) for rule, w, r in rules])
    value = F.when(first["winner"] == "incoming", pair["incoming"]).otherwise(pair["existing"])
    return F.struct(
        pair["field"].alias("field"), pair["existing"].alias("existing"), pair["incoming"].alias("incoming"),
        first["winner"].alias("winner"), first["reason"].alias("reason"), value.alias("value"),
    )


def resolve_whole(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each incoming product resolved against the existing one of its canonical id: whole fields, attributes, images.

    Both sides have canonicalProductId, id, source, lastSyncedAt, the fields, attributes (a map of texts) and images.
    Gives canonicalProductId, productId, the six fields, attributes (all names of both sides, each decided like a field),
    images (those of the existing product first, trimmed, each once, blank ones left out) and conflicts, an array with
    field, existing, incoming, winner and reason for what differs; attributes count as ``attributes.<name>``.
    Rows without a canonical id and incoming ones without an existing one give nothing; null maps and lists are empty.
    All is decided within the row of a pair, after one join.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where("canonicalProductId is not null").select("canonicalProductId", F.struct(
            "id", X.source_priority(F.col("source")).alias("priority"), F.col("lastSyncedAt").alias("time"), *WHOLE_FIELDS,
            F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
            F.coalesce("images", F.array().cast("array<string>")).alias("images"),
        ).alias(name))

    e, i = F.col("e"), F.col("i")
    pair = lambda field, a, b: F.struct(field.alias("field"), a.alias("existing"), b.alias("incoming"))
    decide = lambda pairs: F.transform(pairs, lambda p: decided(p, e["priority"], i["priority"], e["time"], i["time"]))
    named = F.transform(F.map_keys(i["attributes"]), lambda k: pair(k, F.try_element_at(e["attributes"], k), i["attributes"][k]))
    told = side(existing, "e").join(side(incoming, "i"), "canonicalProductId").select(
        "*", decide(F.array(*[pair(F.lit(f), e[f], i[f]) for f in WHOLE_FIELDS])).alias("fields"), decide(named).alias("named"),
    )
    kept = F.map_filter(e["attributes"], lambda k, _: ~F.map_contains_key(i["attributes"], k))
    won = F.map_from_entries(F.transform("named", lambda d: F.struct(d["field"], d["value"])))
    prefixed = F.transform("named", lambda d: d.withField("field", F.concat(F.lit("attributes."), d["field"])))
    differ = F.filter(F.concat("fields", prefixed), lambda d: ~d["existing"].eqNullSafe(d["incoming"]))
    urls = F.array_distinct(F.filter(F.transform(F.concat(e["images"], i["images"]), lambda u: X.blank_to_null(u)), lambda u: u.isNotNull()))
    return told.select(
        "canonicalProductId", i["id"].alias("productId"), *[F.element_at("fields", n + 1)["value"].alias(f) for n, f in enumerate(WHOLE_FIELDS)],
        F.map_concat(kept, won).alias("attributes"), urls.alias("images"), F.transform(differ, lambda d: d.dropFields("value")).alias("conflicts"),
    )


def conflict_report(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("field", "reason", "winner").agg(F.count("*").alias("conflicts"))


def merge_matched(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming values where filled, else those of the matched existing row, whose id stays."""
    fields = ("sku", "brand", "title", "category")
    old = existing.select(*keys, F.col("id").alias("old_id"), *[F.col(f).alias(f"old_{f}") for f in fields if f not in keys])
    joined = incoming.join(old, keys, "left")
    merged = [F.coalesce(X.blank_to_null(F.col(f)), F.col(f"old_{f}")).alias(f) for f in fields if f not in keys]
    return joined.select(F.coalesce("old_id", "id").alias("id"), *keys, *merged)


def deactivate_products(products: DataFrame, deleted: DataFrame) -> DataFrame:
    """Products with status inactive where ``deleted`` (id) has them."""
    gone = deleted.select("id", F.lit(True).alias("gone")).distinct()
    return products.join(gone, "id", "left").withColumn("status", F.when(F.col("gone"), "inactive").otherwise(F.col("status"))).drop("gone")


def deactivate_offers(offers: DataFrame, deleted: DataFrame) -> DataFrame:
    """Offers of deleted products out of stock."""
    gone = deleted.select(F.col("id").alias("productId"), F.lit(True).alias("gone")).distinct()
    joined = offers.join(gone, "productId", "left")
    return joined.withColumns({
        "availability": F.when(F.col("gone"), "out_of_stock").otherwise(F.col("availability")),
        "isInStock": F.col("isInStock") & F.col("gone").isNull(),
    }).drop("gone")


def resolve_variants(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Variants of both sides (canonicalId, sku, variantId, price, availability, priority) merged by key.

    The key is the SKU in lower case, else the variant's id. Of a matched pair, the source with the smaller priority
    number wins and the other fills its gaps; unmatched variants stay, and those without a key are never matched.
    """
    keyed = lambda df: df.withColumn("key", F.coalesce(F.lower(X.blank_to_null(F.col("sku"))), X.blank_to_null(F.col("variantId"))))
    side = lambda df, s: keyed(df).select("canonicalId", "key", *[F.col(c).alias(f"{c}_{s}") for c in ("sku", "variantId", "price", "availability", "priority")])
    joined = side(existing, "e").join(side(incoming, "i"), ["canonicalId", "key"], "full_outer")
    old, new = F.col("priority_e").isNotNull(), F.col("priority_i").isNotNull()
    first = F.when(old & (~new | (F.col("priority_e") <= F.col("priority_i"))), True).otherwise(False)
    pick = lambda c: F.when(first, F.coalesce(f"{c}_e", f"{c}_i")).otherwise(F.coalesce(f"{c}_i", f"{c}_e")).alias(c)
    state = F.when(old & new, "updated").when(new, "added").otherwise("kept")
    return joined.select("canonicalId", pick("sku"), pick("variantId"), pick("price"), pick("availability"), state.alias("state"))

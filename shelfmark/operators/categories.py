"""Category trees and the links of products to categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import exprs as X
from shelfmark.sources.shared import stored


def join_parent_category(categories: DataFrame) -> DataFrame:
    """Categories (sourceId, parentSourceId, name) with the id of their parent; null for a root or an unknown parent."""
    own = categories.withColumn("id", F.concat(F.lit("cat_"), F.substring(F.sha2("sourceId", 256), 1, 16)))
    parents = own.select(F.col("sourceId").alias("parentSourceId"), F.col("id").alias("parentId")).distinct()  # an id is told by its sourceId
    return own.join(parents, "parentSourceId", "left")


def norm_woo_categories(categories: DataFrame) -> DataFrame:
    """Parent 0 is none; level 1 with a parent, else 0."""
    parent = F.nullif(F.col("parentSourceId"), F.lit("0"))
    named = join_parent_category(categories.withColumn("parentSourceId", parent))
    return named.select("id", "sourceId", "name", "parentId", F.when(F.col("parentSourceId").isNotNull(), 1).otherwise(0).alias("level"))


def norm_shopify_categories(collections: DataFrame) -> DataFrame:
    """Flat collections at level 0."""
    return collections.select("sourceId", X.blank_to_null(F.col("name")).alias("name"), F.lit(0).alias("level"), F.coalesce("productsCount", F.lit(0)).alias("productsCount"))


def category_levels(categories: DataFrame) -> DataFrame:
    """Depth of each category below a root; null for one that no root leads to, as in a cycle or below an unknown parent.

    A sourceId is walked once, from the smallest of its parents if its rows name several; each of its rows gets the level.
    Every round doubles the steps that a row has gone up, so a tree of depth d takes log2(d) + 1 rounds.
    """
    once = categories.where("sourceId is not null").groupBy("sourceId").agg(F.min("parentSourceId").alias("up"))
    steps = once.select("sourceId", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("level"))
    steps = stored(steps, "levels")
    for _ in range(max(1, steps.count()).bit_length() + 1):
        if steps.where("up is not null").isEmpty():
            break
        above = steps.select(F.col("sourceId").alias("up"), F.col("up").alias("upper"), F.col("level").alias("more"), F.lit(True).alias("known"))
        joined = steps.where("level is not null").join(above, "up", "left")
        lost = F.col("up").isNotNull() & (F.col("known").isNull() | F.col("more").isNull())
        level = F.when(~lost, F.col("level") + F.when(F.col("up").isNull(), 0).otherwise(F.col("more")))
        steps = stored(joined.select("sourceId", F.when(~lost, F.col("upper")).alias("up"), level.cast("int").alias("level")).unionByName(steps.where("level is null")), "levels")
    found = steps.select("sourceId", F.when(F.col("up").isNull(), F.col("level")).alias("level"))
    return categories.join(found, "sourceId", "left")


def norm_bigcommerce_categories(categories: DataFrame) -> DataFrame:
    """Slug without outer slashes, parent 0 is none, level is the depth."""
    parent = F.nullif(F.col("parentSourceId"), F.lit("0"))
    slug = F.regexp_replace("url", "^/+|/+$", "")
    return category_levels(categories.withColumn("parentSourceId", parent)).select("sourceId", "name", slug.alias("slug"), "parentSourceId", "level")


def norm_magento_categories(trees: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes of landed trees (column tree, JSON) below the root, with their parent and level; all, or ``depth`` levels."""
    node = F.from_json("tree", "id string, name string, children_data array<string>")
    rows, found, level = trees.select(node.alias("node")), None, 0
    while depth is None or level < depth:
        level += 1
        up = F.col("node.id") if level > 1 else F.lit(None).cast("string")
        children = stored(rows.select(up.alias("parentId"), F.explode("node.children_data").alias("tree")), "nodes")
        if children.isEmpty() and found is not None:
            break
        rows = children.select("parentId", node.alias("node"))
        named = rows.select(F.col("node.id").alias("sourceId"), F.col("node.name").alias("name"), "parentId", F.lit(level).alias("level"))
        found = named if found is None else found.unionByName(named)
    return found


def link_categories(products: DataFrame, raw_ids: str, categories: DataFrame) -> DataFrame:
    """id, sorted categoryIds that exist, and how many raw ids don't."""
    each = products.select("id", F.explode_outer(raw_ids).alias("sourceId"))
    known = categories.select("sourceId", F.col("id").alias("categoryId"))
    linked = each.join(known, "sourceId", "left")
    return linked.groupBy("id").agg(
        F.array_sort(F.collect_set("categoryId")).alias("categoryIds"), F.count_if(F.col("sourceId").isNotNull() & F.col("categoryId").isNull()).alias("missing")
    )


def unmatched_categories(linked: DataFrame) -> DataFrame:
    """Products with raw categories of which none, or not all, exist."""
    return linked.where("missing > 0")


def validate_categories(categories: DataFrame) -> DataFrame:
    rules = [
        ("required:sourceId", X.blank_to_null(F.col("sourceId")).isNull()),
        ("required:name", X.blank_to_null(F.col("name")).isNull()),
        ("maxLength:name", F.length("name") > 255),
        ("parent:self", F.col("sourceId") == F.col("parentSourceId")),
    ]
    return categories.withColumn("errors", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules])))

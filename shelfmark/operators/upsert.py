"""Keyed upserts as joins and rankings, for tables without MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_replace(target: DataFrame, source: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Whole rows by key: the source's, of several the latest by ``order``; null keys are rejected."""
    rows = target.withColumn("_new", F.lit(0)).unionByName(source.withColumn("_new", F.lit(1)))
    whole = F.struct(*target.columns)
    last = F.max_by(whole, F.struct("_new", order))
    return rows.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(last.alias("r")).select("r.*")


def upsert_patch(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Fields that the source gives replace the target's, others stay; new keys are added. A key occurs once in each."""
    given = [c for c in source.columns if c not in keys]
    patch = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in given])
    joined = target.join(patch, keys, "full_outer")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in target.columns])


def upsert_given(target: DataFrame, source: DataFrame, keys: list[str], given: str) -> DataFrame:
    """As ``upsert_patch``, but fields named in the array ``given`` are set even to null, and others never."""
    fields = [c for c in source.columns if c not in (*keys, given)]
    patch = source.select(*keys, F.col(given).alias("_given"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = target.join(patch, keys, "full_outer")
    new = lambda c: F.coalesce(F.array_contains("_given", c), F.lit(False))
    return joined.select(*[F.when(new(c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in target.columns])


def insert_only(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the source whose key is new are added."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys).select(target.columns))


def add_to_set(products: DataFrame, links: DataFrame, key: str, column: str) -> DataFrame:
    """Values of ``links`` added to an array column unless present."""
    added = links.groupBy(key).agg(F.array_sort(F.collect_set(column)).alias("_added"))
    none = F.array().cast("array<string>")
    return products.join(added, key, "left").withColumn(column, F.array_union(F.coalesce(column, none), F.coalesce("_added", none))).drop("_added")


def upsert_offer_keys(offers: DataFrame, incoming: DataFrame, products: DataFrame) -> DataFrame:
    """Offers with incoming ones (sourceId, storeId, variantId, price), skipping those without a key part.

    The product is resolved by (sourceId, storeId), of several the one with the smallest id; older offers of that pair
    without a variant go. Of incoming rows with equal keys the one with the lowest price counts.
    """
    usable = incoming.where("sourceId is not null and storeId is not null and variantId is not null")
    rest = sorted((c for c in incoming.columns if c not in ("sourceId", "storeId", "variantId")), key=lambda c: (c != "price", c))
    lowest = F.min(F.struct(*rest)).alias("r")
    usable = usable.groupBy("sourceId", "storeId", "variantId").agg(lowest).select("sourceId", "storeId", "variantId", "r.*")
    resolved = usable.join(products.groupBy("sourceId", "storeId").agg(F.min("id").alias("productId")), ["sourceId", "storeId"], "left")
    pairs = usable.select("sourceId", "storeId").distinct().withColumn("renewed", F.lit(True))
    kept = offers.join(pairs, ["sourceId", "storeId"], "left").where("not (coalesce(renewed, false) and variantId is null)").drop("renewed")
    old = kept.join(usable.select("sourceId", "storeId", "variantId"), ["sourceId", "storeId", "variantId"], "left_anti")
    return old.unionByName(resolved.select(old.columns))


def array_element_patch(products: DataFrame, patches: DataFrame) -> DataFrame:
    """Products (id, variants) whose variants take the quantity that ``patches`` (sku, quantity) give their SKU."""
    wanted = products.select("id", F.explode("variants").alias("v")).select("id", F.col("v.sku").alias("sku")).join(patches.dropDuplicates(["sku"]), "sku")
    by_product = wanted.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("sku", "quantity"))).alias("new"))
    joined = products.join(by_product, "id", "left")
    patch = lambda v: F.coalesce(F.try_element_at("new", F.coalesce(v["sku"], F.lit(""))).cast("double"), v["inventoryQty"])
    changed = F.transform("variants", lambda v: v.withField("inventoryQty", patch(v)).withField("isInStock", F.coalesce(patch(v) > 0, v["isInStock"])))
    return joined.withColumn("variants", changed).drop("new")


SOURCE_ID_PATHS = ["$.id", "$.sku", "$.itemTypeSKU", "$.product_id", "$.variant_id"]


def raw_archive(bronze: DataFrame, landed: DataFrame, arrived: str | None = None, parts: int = 1) -> DataFrame:
    """Archive (platform, sourceId, payload) with landed payloads; the last payload of a key stays, keyless ones are all kept.

    Last is by the column ``arrived``, of equal times or without one the greatest text. With many payloads, ``parts`` says
    into how many parts these are dealt.
    """
    key = F.coalesce(*[F.get_json_object("payload", path) for path in SOURCE_ID_PATHS])
    new = landed.select("platform", key.alias("sourceId"), "payload", (F.col(arrived) if arrived else F.lit(None)).alias("at"))
    known = new.where("sourceId is not null")
    known = known.repartition(parts, "platform", "sourceId") if parts > 1 else known
    keyed = known.groupBy("platform", "sourceId").agg(F.max(F.struct("at", "payload"))["payload"].alias("payload"))
    old = bronze.join(keyed.select("platform", "sourceId"), ["platform", "sourceId"], "left_anti")
    return old.unionByName(keyed).unionByName(new.where("sourceId is null").drop("at"))


def dead_letter_log(failed: DataFrame, new: DataFrame, resolved: DataFrame, as_of) -> DataFrame:
    """Failed jobs (jobId, state, failedAt, resolvedAt) with new ones; those named by ``resolved`` are closed."""
    rows = failed.unionByName(new.join(failed.select("jobId"), "jobId", "left_anti"))
    closed = resolved.select("jobId", F.lit(True).alias("closed")).distinct()
    joined = rows.join(closed, "jobId", "left")
    return joined.withColumns({
        "resolvedAt": F.when(F.col("closed"), F.coalesce("resolvedAt", F.lit(as_of))).otherwise(F.col("resolvedAt")),
        "state": F.when(F.col("closed"), "resolved").otherwise(F.col("state")),
    }).drop("closed")

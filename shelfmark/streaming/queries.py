"""Stream queries over the events table: it is read as a stream of files and drained once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shelfmark.functions.exprs import availability_threshold, literal_map
from shelfmark.operators import survive, upsert
from shelfmark.plans import views
from shelfmark.plans.views import TOPICS
from shelfmark.sources.shared import shared_folder
from shelfmark.streaming import events as S


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the folder as a stream."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a glob may be a file or a folder


def webhook_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_stream(spark, sf_dir).select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("webhookId"),
        literal_map(TOPICS)[F.col("event_type")].alias("topic"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "value",
    )


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream gives over the input that is there now, written batch by batch to the shared folder.

    In append mode all rows count; in update mode, of the rows with the same ``keys`` that of the last batch.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    if mode == "update":
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r")).select("r.*")
    return rows.select(*stream.columns)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(S.stream_dedup(webhook_stream(spark, sf_dir)), "append").select("webhookId", "topic").distinct()


def stream_api_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = event_stream(spark, sf_dir).select(
        F.col("event_type").alias("endpoint"), (F.col("event_type") == "error").alias("isError"),
        F.floor(F.col("value") * 10).cast("long").alias("durationMs"), F.col("ts").cast("timestamp").alias("ts"),
    )
    return drained(S.stream_api_hourly(calls), "update", ["endpoint", "hour"])


def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(S.latest_state(webhook_stream(spark, sf_dir), "user_id"), "update", ["user_id"])


def stream_late_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected events, of events that came value * 2 seconds after they were made."""
    came = webhook_stream(spark, sf_dir).withColumn("received", F.timestamp_add("SECOND", F.floor(F.col("value") * 2).cast("int"), F.col("ts")))
    return drained(S.late_split(came)[1].select("event_id", "topic"), "append")


def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the handler that took them, through foreachBatch."""
    base = f"{shared_folder(spark)}/routed-{uuid.uuid4().hex}"

    def each(batch: DataFrame, number: int) -> None:
        def write(topic: str):
            return lambda rows: rows.select("event_id", F.lit(topic).alias("handler")).write.mode("overwrite").parquet(f"{base}/out/{topic}/batch={number}")

        S.route(batch, {topic: write(topic) for topic in ("create", "update", "delete", "inventory")})

    query = webhook_stream(spark, sf_dir).writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/out").select("event_id", "handler")


QUERIES = {f.__name__: f for f in (stream_dedup, stream_api_hourly, stream_latest_state, stream_late_reject, stream_route)}


#: Parts of a table that a stream changes; a batch rewrites only those that hold its keys.
BUCKETS = 16


def applied(stream: DataFrame, initial: DataFrame, key: str, changes, apply) -> DataFrame:
    """The table that ``apply(table, changes(batch))`` makes of ``initial`` over all batches.

    Table and changes have the column ``key`` and are dealt into buckets by it. Batch n reads the latest versions before
    it of the buckets with changes, and writes these anew as version n + 1, so a repeated batch gives the same again.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/applied-{uuid.uuid4().hex}"
    bucketed = lambda rows: rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    versions: dict[int, dict[int, bool]] = {b: {} for b in range(BUCKETS)}  # whether a version holds rows

    def write(rows: DataFrame, version: int, buckets: list[int]) -> None:
        path = f"{base}/v{version}"
        bucketed(rows.select(initial.columns)).write.mode("overwrite").partitionBy("bucket").parquet(path)
        whole = StructType([*initial.schema.fields, StructField("bucket", IntegerType())])
        held = {row.bucket for row in spark.read.schema(whole).parquet(path).select("bucket").distinct().collect()}
        for b in buckets:
            versions[b][version] = b in held

    def current(buckets: list[int], before: int) -> DataFrame:
        last = {b: max(v for v in versions[b] if v < before) for b in buckets}
        paths = [f"{base}/v{v}/bucket={b}" for b, v in last.items() if versions[b][v]]
        return spark.read.schema(initial.schema).parquet(*paths) if paths else initial.limit(0)

    write(initial, 0, list(range(BUCKETS)))

    def each(batch: DataFrame, number: int) -> None:
        new = changes(batch)
        touched = sorted(row.bucket for row in bucketed(new).select("bucket").distinct().collect())
        if touched:
            write(apply(current(touched, number + 1), new), number + 1, touched)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return current(list(range(BUCKETS)), 1 << 62)


def _latest(batch: DataFrame, topics: list[str], **columns) -> DataFrame:
    """The last event of each user among the topics, as columns."""
    last = F.max_by(F.struct("value", "ts", "topic"), F.struct("ts", "event_id"))
    found = batch.where(F.col("topic").isin(topics)).groupBy("user_id").agg(last.alias("e"))
    return found.select(*[c.alias(n) for n, c in columns.items()])


def stream_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of delete events become inactive."""
    products = views.products(spark, sf_dir).select("id", "status")
    gone = lambda batch: _latest(batch, ["delete"], id=F.concat(F.lit("prod_"), F.col("user_id").cast("string")))
    return applied(webhook_stream(spark, sf_dir), products, "id", gone, survive.deactivate_products)


def stream_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers take the quantity of the last inventory event of their SKU; no quantity means in stock."""
    offers = views.offers(spark, sf_dir).select("id", "sku", "stockQty", "availability", "isInStock")
    quantity = F.when(F.col("e.value") < 100, F.floor("e.value").cast("long"))

    def changes(batch: DataFrame) -> DataFrame:
        return _latest(batch, ["inventory"], sku=F.concat(F.lit("SKU-"), F.col("user_id").cast("string")), q=quantity, hit=F.lit(True))

    def patch(table_now: DataFrame, new: DataFrame) -> DataFrame:
        joined = table_now.join(new, "sku", "left")
        hit = F.col("hit").isNotNull()
        state = availability_threshold(F.col("q"))
        return joined.select(
            "id", "sku", F.when(hit, F.col("q")).otherwise(F.col("stockQty")).alias("stockQty"), F.when(hit, state).otherwise(F.col("availability")).alias("availability"),
            F.when(hit, state != "out_of_stock").otherwise(F.col("isInStock")).alias("isInStock"),
        )

    return applied(webhook_stream(spark, sf_dir), offers, "sku", changes, patch)


def stream_product_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create and update events set a product's price; unknown products are added."""
    products = views.products(spark, sf_dir).select(F.col("sourceId"), "price", F.lit(None).cast("timestamp").alias("lastSyncedAt"))
    new = lambda batch: _latest(batch, ["create", "update"], sourceId=F.concat(F.lit("u"), F.col("user_id").cast("string")).substr(F.when(F.col("user_id") < 50, 2).otherwise(1), F.lit(20)), price=F.col("e.value"), lastSyncedAt=F.col("e.ts"))
    return applied(webhook_stream(spark, sf_dir), products, "sourceId", new, lambda table_now, rows: upsert.upsert_replace(table_now, rows, ["sourceId"], "lastSyncedAt"))


def stream_incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor per user: the last time of a batch, which only batches without an error of that user advance."""
    empty = spark.createDataFrame([], "user_id long, since timestamp")

    def seen(batch: DataFrame) -> DataFrame:
        last = batch.groupBy("user_id").agg(F.max("ts").alias("since"), F.count_if(F.col("topic") == "delete").alias("failed"))
        return last.where("failed = 0").select("user_id", "since")

    stream = webhook_stream(spark, sf_dir).where("user_id % 3 <> 0 or topic <> 'delete'")
    return applied(stream, empty, "user_id", seen, lambda table_now, rows: upsert.upsert_patch(table_now, rows, ["user_id"]))


QUERIES |= {f.__name__: f for f in (stream_delete, stream_inventory, stream_product_upsert, stream_incremental_sync)}

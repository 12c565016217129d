"""Operational metrics of syncs, calls and stores; ``as_of`` stands for now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retention(rows: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    """Rows not older than ``days``."""
    return rows.where(F.col(ts) >= F.lit(as_of) - F.make_interval(days=F.lit(days)))


def ingestion_metrics(syncs: DataFrame, as_of) -> DataFrame:
    """The last 24 hours in total (platform null) and per platform, in one pass."""
    recent = retention(syncs, "ts", as_of, 1)
    counted = recent.groupingSets([[], ["platform"]], "platform").agg(
        F.count("*").alias("syncs"),
        F.sum("successProducts").alias("products"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "partial").alias("partial"),
        F.sum("durationMs").alias("durationMs"),
    )
    return counted.withColumn("successRate", F.round(100 * F.col("success") / F.col("syncs"), 1))


def api_metrics_hourly(calls: DataFrame) -> DataFrame:
    """Requests, errors and time per endpoint and hour."""
    return calls.groupBy("endpoint", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count("*").alias("requests"), F.count_if("isError").alias("errors"), F.sum("durationMs").alias("totalMs")
    )


def api_metrics_last_hour(hourly: DataFrame, as_of) -> DataFrame:
    """Per endpoint over the buckets from the hour that began an hour ago or earlier."""
    start = F.date_trunc("hour", F.lit(as_of) - F.make_interval(hours=F.lit(1)))
    summed = hourly.where(F.col("hour") >= start).groupBy("endpoint").agg(
        F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.sum("totalMs").alias("totalMs")
    )
    return summed.withColumn("errorRate", F.round(100 * F.col("errors") / F.col("requests"), 4)).withColumn("averageMs", F.round(F.col("totalMs") / F.col("requests"), 4))


def api_slowest(hourly: DataFrame, as_of, k: int = 3) -> DataFrame:
    """The k endpoints with the highest mean time over 24 hours."""
    recent = retention(hourly, "hour", as_of, 1).groupBy("endpoint").agg((F.sum("totalMs") / F.sum("requests")).alias("mean"))
    return recent.orderBy(F.desc("mean"), "endpoint").limit(k).select("endpoint", F.round("mean", 6).alias("averageMs"))


def latest_sync(syncs: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id"))
    return syncs.groupBy("storeId").agg(last.alias("l")).select("storeId", F.col("l.status").alias("lastStatus"), F.col("l.ts").alias("lastSync"))


def sync_status(stores: DataFrame, syncs: DataFrame) -> DataFrame:
    """Last sync of every store, null where it never synced."""
    return stores.select(F.col("id").alias("storeId"), "name", "platform").join(latest_sync(syncs), "storeId", "left")


def cursor_state(syncs: DataFrame) -> DataFrame:
    """Where the next incremental sync of each store starts: its last success; without one a full sync."""
    since = F.max(F.when(F.col("status") == "success", F.col("ts")))
    return syncs.groupBy("storeId").agg(since.alias("since")).withColumn("isFullSync", F.col("since").isNull())


def store_metrics(stores: DataFrame, syncs: DataFrame, as_of) -> DataFrame:
    """Per store the syncs and products of the day, and the last status."""
    day = F.date_trunc("day", F.lit(as_of))
    today = syncs.groupBy("storeId").agg(
        F.count_if(F.col("ts") >= day).alias("syncsToday"),
        F.coalesce(F.sum(F.when(F.col("ts") >= day, F.col("successProducts"))), F.lit(0)).alias("productsToday"),
    )
    return sync_status(stores, syncs).join(today, "storeId", "left").fillna(0, ["syncsToday", "productsToday"])


def store_totals(stores: DataFrame, syncs: DataFrame, as_of) -> DataFrame:
    per = store_metrics(stores, syncs, as_of)
    return per.agg(
        F.count("*").alias("stores"), F.count_if(F.col("lastStatus") == "success").alias("active"),
        F.count_if(F.col("syncsToday") > 0).alias("syncedToday"), F.count_if(F.col("lastSync").isNull()).alias("neverSynced"),
    )


def store_metrics_day(stores: DataFrame, syncs: DataFrame, as_of) -> DataFrame:
    """Per store the syncs and products of the 24 hours up to ``as_of``, its last sync and whether that failed.

    A store fails when its last sync did so in whole or in part. Stores without syncs have zeros and null.
    """
    recent = F.col("ts") >= F.lit(as_of) - F.expr("INTERVAL 24 HOURS")
    per = syncs.groupBy("storeId").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("lastStatus"), F.max("ts").alias("lastSync"),
        F.count_if(recent).alias("syncs"), F.sum(F.when(recent, F.col("successProducts"))).alias("products"),
    )
    joined = stores.select(F.col("id").alias("storeId")).join(per, "storeId", "left").fillna(0, ["syncs", "products"])
    return joined.withColumns({
        "failing": F.coalesce(F.col("lastStatus").isin("failed", "partial"), F.lit(False)),
        "synced": F.coalesce(F.col("lastSync") >= F.lit(as_of) - F.expr("INTERVAL 24 HOURS"), F.lit(False)),
    })


def dead_letters(syncs: DataFrame) -> DataFrame:
    """Failed syncs that wait for a review, latest first."""
    failed = syncs.where(F.col("status") == "failed")
    return failed.select(F.col("event_id").alias("jobId"), "storeId", "platform", F.lit("pending_review").alias("state"), F.col("ts").alias("failedAt")).orderBy(F.desc("failedAt"), "jobId")


def health_rollup(failed: DataFrame, issues: DataFrame) -> DataFrame:
    """degraded from 5 waiting failures or 10 open critical issues on."""
    waiting = failed.select((F.col("state") == "pending_review").alias("waits"), F.lit(False).alias("hurts"))
    hurting = issues.select(F.lit(False).alias("waits"), ((F.col("severity") == "critical") & ~F.col("resolved")).alias("hurts"))
    counted = waiting.unionByName(hurting).agg(F.count_if("waits").alias("pending"), F.count_if("hurts").alias("critical"))
    return counted.withColumn("status", F.when((F.col("pending") >= 5) | (F.col("critical") >= 10), "degraded").otherwise("healthy"))


def issue_summary(issues: DataFrame, k: int = 10) -> DataFrame:
    """Open issues per code, the k most frequent."""
    counts = issues.where(~F.col("resolved")).groupBy("issueCode", "severity").agg(F.count("*").alias("issues"))
    return counts.orderBy(F.desc("issues"), "issueCode").limit(k)

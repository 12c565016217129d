"""Change events and call metrics as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["webhookId", "topic"]


#: With the shop's platform and store, as one id may come from several.
STORE_KEYS = ["webhookId", "platform", "topic", "storeId"]


def stream_dedup(events: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The first event of each id and topic within 24 hours; events without an id are never dropped.

    For a stream with the columns of ``keys`` and ts; state is kept for 24 hours.
    """
    known = events.where("webhookId is not null").withWatermark("ts", "24 hours").dropDuplicatesWithinWatermark(keys)
    return known.unionByName(events.where("webhookId is null").withWatermark("ts", "24 hours"))


def late_split(events: DataFrame, received: str = "received", late: int = 300, early: int = 30) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected events: rejected if made over ``late`` s before or ``early`` s after they came."""
    age = F.unix_timestamp(received) - F.unix_timestamp("ts")
    bad = F.coalesce((age > late) | (age < -early), F.lit(False))
    return events.where(~bad), events.where(bad)


def stream_api_hourly(calls: DataFrame) -> DataFrame:
    """Hourly counts per endpoint, a day late at most."""
    windowed = calls.withWatermark("ts", "24 hours").groupBy(F.window("ts", "1 hour"), "endpoint")
    counted = windowed.agg(F.count("*").alias("requests"), F.count_if("isError").alias("errors"), F.sum("durationMs").alias("totalMs"))
    return counted.select("endpoint", F.col("window.start").alias("hour"), "requests", "errors", "totalMs")


def latest_state(events: DataFrame, key: str) -> DataFrame:
    """The last event of each key, for a stream in update or complete mode."""
    whole = F.struct(*[c for c in events.columns if c != key])
    return events.groupBy(key).agg(F.max_by(whole, F.struct("ts", "event_id")).alias("e")).select(key, "e.*")


def route(batch: DataFrame, handlers: dict) -> None:
    """Hands the events of each topic to its handler; for foreachBatch. Topics without one are left."""
    batch.persist()
    try:
        for topic, handle in handlers.items():
            handle(batch.where(F.col("topic") == topic))
    finally:
        batch.unpersist()

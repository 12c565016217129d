"""Joins on keys of which some hold a great share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in so many (and more than so many rows) is split into SPLIT parts.
HOT_SHARE, HOT_ROWS, SPLIT = 1000, 1000, 64


def hot_keys(rows: DataFrame, key: str) -> list[int]:
    """The values of ``key`` with more than a thousandth of all rows; a thousand at most."""
    most = max(HOT_ROWS, (n := rows.count()) // HOT_SHARE)
    if n <= most:
        return []
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    return [row[0] for row in counts.where(F.col("count") > most).select(key).collect()]


def join_one(rows: DataFrame, one: DataFrame, key: str, how: str = "inner", hot: list[int] | None = None) -> DataFrame:
    """``rows`` joined with ``one``, which has a row for each key at most; the rows of hot keys are split."""
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(one, key, how)
    is_hot = F.col(key).isin(hot)
    # Any part will do, also of equal rows.
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *(c for c in rows.columns if c != key)), F.lit(SPLIT))
    every = F.sequence(F.lit(0).cast("long"), F.lit(SPLIT - 1).cast("long"))
    left = rows.withColumn("salt", F.when(is_hot, spread).otherwise(F.lit(0).cast("long")))
    right = one.withColumn("salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0).cast("long")))))
    return left.join(right, [key, "salt"], how).drop("salt")

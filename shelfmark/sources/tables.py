"""Parquet tables of a scale-factor folder."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(rows: DataFrame, each: int) -> int:
    """Into how many parts of about ``each`` rows a table goes; its files tell their rows, so none is read for it."""
    return max(1, math.ceil(rows.count() / each))


def spread(rows: DataFrame, each: int, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` into parts of about ``each`` rows: a file that packs many narrow rows would be a task or two."""
    n = parts(rows, each)
    return rows.repartition(n, key) if n > 1 else rows

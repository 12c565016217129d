"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; a null id has remainder 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """doc_id, text, label of at most ``limit`` labelled ids, a row each, the same ones at every run.

    ``labels`` has doc_id and label. Ids are taken by their hash, so no id is favoured; only they are broadcast. Of
    contradicting labels of an id the larger one counts, of different texts the one with the smallest hash.
    """
    ids = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    first = F.min(F.struct(F.xxhash64("text"), "text"))
    return rows.groupBy("doc_id", "label").agg(first["text"].alias("text")).select("doc_id", "text", "label")


def fold_of(doc_id: Column, folds: int) -> Column:
    """The fold of an id, by its hash."""
    return F.pmod(F.xxhash64(doc_id), F.lit(folds)).cast("int")

"""A corpus pipeline of four stages: toxicity, line quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Labels for the classifiers come from ``sf_dir``; the
near-duplicate stage keeps the document with the smallest id of each component, and its repeated rows.

Defined results: null and empty texts get what the classifiers say of an empty text, are no one's near duplicates, and
pack as the end id; rows without an id are judged by their text, and stay in the near-duplicate stage; rows that repeat
are judged alike and all stay or go; of an id with several texts, all go if one is a copy of a smaller id's; without
labels nothing is toxic, and every line is as likely good as bad; empty tables stay empty; extra columns, whatever their
names, are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.batches import quoted
from shelfmark.llm.jaccard_join import similar_sets
from shelfmark.llm.line_crf import filter_quality
from shelfmark.llm.packing import pack_documents
from shelfmark.llm.queries import tokenizer_path
from shelfmark.llm.shared import stored
from shelfmark.llm.toxicity import filter_toxicity
from shelfmark.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic."""
    return filter_toxicity(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field finds good."""
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; documents without an id stay."""
    found = similar_sets(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*quoted(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: The learned stages have no SQL; each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

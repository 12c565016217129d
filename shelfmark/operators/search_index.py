"""A text index on disk: postings by term, in buckets, that searches read instead of the texts.

The index is a folder with three tables. ``postings`` (term, key, field, times, words; by segment and bucket of the term)
says how often a term stands in a field of a document and how many words the field has; within a bucket, files are ranges
of term and key, so a term of very many documents lies in several files, and a search skips files by their terms.
``changed`` (key; by segment) holds the documents that a segment speaks for, and ``segments`` names the segments that are
whole: its row is written last, so a build that was stopped leaves files that no search reads.

A change of some documents adds a segment with their postings and their keys. Of a document, only the postings of its last
segment count; a removed one has none there. ``compact`` writes what counts as a new base, before which nothing is read.

Keys are texts. Documents without a key are left out; of rows with the same key, that with the smallest fields counts.
Null fields have no words; documents without words are in no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BUCKETS = 64
POSTINGS = "term string, key string, field string, times long, words long, segment int, bucket int"
SPLIT = "[^a-z0-9]+"


def words_of(text) -> F.Column:
    """The words of a text in lower case: runs of a to z and 0 to 9."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


class SearchIndex:
    """``fields``: the weight of each field of the documents; ``buckets`` must stay as it was when the index was begun."""

    def __init__(self, spark: SparkSession, folder: str, fields: dict[str, float], buckets: int = BUCKETS):
        self.spark, self.folder, self.fields, self.buckets = spark, folder, fields, buckets

    def segments(self) -> list[int]:
        """The last base and the segments after it: one number for each change since then."""
        try:
            rows = self.spark.read.parquet(f"{self.folder}/segments").collect()
        except AnalysisException:  # no segment yet
            return []
        base = max(r.segment for r in rows if r.base)
        return sorted(r.segment for r in rows if r.segment >= base)

    def postings(self, docs: DataFrame, key: str) -> DataFrame:
        """term, key, field, times, words of the documents: one shuffle, by ranges of bucket, term and key."""
        one = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.min(F.struct(*self.fields)).alias("d"))
        told = F.array(*[F.struct(F.lit(f).alias("field"), words_of(F.col("d")[f]).alias("list")) for f in self.fields])
        each = one.select("key", F.inline(told)).select("key", "field", F.size("list").cast("long").alias("words"), F.explode("list").alias("term"))
        return each.withColumn("bucket", self.bucket(F.col("term"))).repartitionByRange("bucket", "term", "key").groupBy("bucket", "term", "key", "field", "words").agg(F.count("*").alias("times"))

    def bucket(self, term) -> F.Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def build(self, docs: DataFrame, key: str) -> None:
        """A new base of all ``docs``."""
        self._add(self.postings(docs, key), None, base=True)

    def change(self, docs: DataFrame, removed: DataFrame, key: str) -> None:
        """A segment in which ``docs`` are as given, and those of ``removed`` (its column ``key``) are gone."""
        keys = docs.select(F.col(key).cast("string").alias("key")).union(removed.select(F.col(key).cast("string"))).where("key is not null").distinct()
        gone = removed.select(F.col(key).cast("string").alias("key")).distinct()
        self._add(self.postings(docs, key).join(gone, "key", "left_anti"), keys, base=False)

    def compact(self) -> None:
        """A new base of the postings that count."""
        self._add(self._last(self._read()).drop("segment").repartitionByRange("bucket", "term", "key"), None, base=True)

    def _add(self, postings: DataFrame, keys: DataFrame | None, base: bool) -> None:
        number = max(self.segments(), default=-1) + 1
        ordered = postings.select("term", "key", "field", "times", "words", "bucket").sortWithinPartitions("bucket", "term", "key")
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/segment={number}")
        if keys is not None:
            keys.write.mode("overwrite").parquet(f"{self.folder}/changed/segment={number}")
        self.spark.createDataFrame([(number, base)], "segment int, base boolean").coalesce(1).write.mode("append").parquet(f"{self.folder}/segments")

    def _read(self) -> DataFrame:
        whole = self.spark.read.schema(POSTINGS).option("basePath", f"{self.folder}/postings")
        return whole.parquet(f"{self.folder}/postings").where(F.col("segment").isin(self.segments()))

    def _last(self, postings: DataFrame) -> DataFrame:
        """The postings of each document's last segment."""
        later = self.segments()[1:]
        if not later:
            return postings
        changed = self.spark.read.schema("key string, segment int").parquet(f"{self.folder}/changed").where(F.col("segment").isin(later))
        last = changed.groupBy("key").agg(F.max("segment").alias("last"))
        return postings.join(last, "key", "left").where("last is null or segment = last").drop("last")

    def search(self, query: str) -> DataFrame:
        """key and score of all documents with a word of the query; score: sum of weight * times / sqrt(words of the field).

        Reads the buckets of the query's words only; a query without words finds nothing.
        """
        words = self.spark.range(1).select(F.array_distinct(words_of(F.lit(query))).alias("w")).select("w", F.transform("w", self.bucket).alias("b")).first()
        found = self._last(self._read().where(F.col("bucket").isin(sorted(set(words.b))) & F.col("term").isin(list(words.w))))
        weight = F.create_map(*[F.lit(x) for f, w in self.fields.items() for x in (f, float(w))])
        part = weight[F.col("field")] * F.col("times") / F.sqrt("words")
        return found.groupBy("key").agg(F.round(F.sum(part), 6).alias("score"))


#: Orders of a page of results.
SORTS = {"relevance": lambda: F.desc("score"), "price_asc": lambda: F.col("priceMin").asc_nulls_first(), "price_desc": lambda: F.desc("priceMax"), "updated_at": lambda: F.desc("updatedAt")}


def search_page(matches: DataFrame, canonical: DataFrame, sort: str = "relevance", number: int = 1, limit: int = 20) -> DataFrame:
    """Page ``number`` of the matches (key, score) that are among ``canonical``, which may be filtered; scores to 2 decimals.

    Ties go to the smaller id; an unknown order is that by relevance.
    """
    joined = canonical.join(matches.withColumnRenamed("key", "canonicalId"), "canonicalId")
    shown = joined.orderBy(SORTS.get(sort, SORTS["relevance"])(), "canonicalId").offset((number - 1) * limit).limit(limit)
    return shown.withColumn("score", F.round("score", 2))

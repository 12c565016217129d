"""Quality rules with a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated five-word windows. For the ratio, the word
n-grams of a text are hashed into ``buckets``; two multinomials over the buckets are estimated with add-``smoothing``,
one from the raw corpus (all documents) and one from trusted documents. A document's score is the sum of
log(p_target / p_raw) over its n-grams divided by their number. Weights are rounded to integers, so that a sum does not
depend on the order of its parts and every document meets the threshold alike at every run.

One pass counts: words are hashed in their document, n-grams of hashes become rows and are partially summed before the
only shuffle, of at most ``buckets`` rows a task. Trusted ids are a bounded sample (``trusted_limit``, by hash of the
id). A second pass measures and scores every document in its row: the weights are one array of ``buckets`` integers,
the result of a scalar subquery, and are summed up within the document. Texts are never shuffled.

Defined results: a null or empty text has no words, fails the base rules and isn't kept; repeated rows get the same
result each; without trusted documents all weights are those of the smoothed uniform target; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.shared import stored

BUCKETS = 1 << 18
SMOOTHING = 0.5
#: Documents below this mean log ratio are not kept.
THRESHOLD = -0.35
#: Trusted documents that the target is estimated from at most.
TRUSTED_LIMIT = 20_000
WINDOW = 5
#: Weights are multiples of 1 / UNIT.
UNIT = 1 << 20


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda word: F.xxhash64(word))


def window_hashes(hashes: Column, n: int) -> Column:
    """A 64-bit hash of each run of ``n`` word hashes, in order."""
    last = F.size(hashes) - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the measures of the base rules, and the hashes h of the words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        words_of(F.col("text")).alias("words"),
        lines.alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    counted = split.select(
        "doc_id",
        "n_symbols",
        word_hashes(F.col("words")).alias("h"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    hashed = counted.withColumn("hashes", window_hashes(F.col("h"), WINDOW))
    # Only texts with a repeated window are sorted.
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = hashed.withColumn("ordered", F.when(repeats, F.sort_array(placed)))
    again = F.filter(
        "ordered",
        lambda e, i: F.coalesce(F.get("ordered", i - 1)["h"] == e["h"], F.lit(False))
        | F.coalesce(F.get("ordered", i + 1)["h"] == e["h"], F.lit(False)),
    )
    starts = F.sort_array(F.transform(again, lambda e: e["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(
            (i + WINDOW).alias("end"), (acc["n"] + F.least(F.lit(WINDOW), i + WINDOW - acc["end"])).alias("n")
        ),
        lambda acc: acc["n"],
    )
    return ordered.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "h",
    )


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of the base rules."""
    return measured(docs).drop("h")


def bucket_of(hashes: list[Column], buckets: int) -> Column:
    """The bucket of a run of word hashes; null if it is cut off."""
    whole = hashes[-1].isNotNull()
    return F.when(whole, F.pmod(F.xxhash64(*hashes), F.lit(buckets)).cast("int"))


def gram_counts(docs: DataFrame, trusted: DataFrame, grams: tuple[int, ...], buckets: int) -> DataFrame:
    """bucket, raw, target: how often n-grams of all, and of trusted documents fall into each bucket."""
    marked = docs.join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left")
    hashed = marked.select("good", word_hashes(words_of(F.col("text"))).alias("h"))
    shifted = [F.slice("h", k + 1, F.size("h")).alias(f"w{k}") for k in range(max(grams))]
    runs = hashed.select("good", F.inline(F.arrays_zip(*shifted)))
    each = F.array(*[bucket_of([F.col(f"w{k}") for k in range(n)], buckets) for n in grams])
    rows = runs.select("good", F.explode(each).alias("bucket")).where("bucket is not null")
    return rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))


def ratio_weights(counts: DataFrame, buckets: int, smoothing: float) -> DataFrame:
    """One row: w, by bucket the log ratio of the trusted to the raw multinomial in units of 1 / UNIT."""
    totals = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    room = smoothing * buckets
    target = (F.col("target") + smoothing) / ((totals.target or 0) + room)
    raw = (F.col("raw") + smoothing) / ((totals.raw or 0) + room)
    weights = counts.select("bucket", F.round(F.log(target / raw) * UNIT).cast("int").alias("w"))
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    dense = every.join(weights, "bucket", "left").select(F.struct("bucket", F.coalesce("w", F.lit(0)).alias("w")).alias("b"))
    return dense.agg(F.sort_array(F.collect_list("b")).alias("b")).select(F.transform("b", lambda b: b["w"]).alias("w"))


def mean_ratio(weights: Column, grams: tuple[int, ...], buckets: int) -> Column:
    """The mean weight of the n-grams of the word hashes h; null without any."""
    nothing = F.lit(0).cast("long")

    def added(w: Column, n: int) -> Column:
        at = lambda run: F.coalesce(F.get(w, bucket_of(run, buckets)), F.lit(0))
        if n == 1:
            return F.aggregate("h", nothing, lambda total, a: total + at([a]))
        if n == 2:
            return F.aggregate(F.zip_with("h", F.slice("h", 2, F.size("h")), lambda a, b: at([a, b])), nothing, lambda total, x: total + x)
        starts = F.when(F.size("h") >= n, F.sequence(F.lit(0), F.size("h") - n))
        return F.coalesce(F.aggregate(starts, nothing, lambda total, i: total + at([F.get("h", i + k) for k in range(n)])), nothing)

    # Within the lambda the array is a variable, so it isn't copied into every row.
    total = F.get(F.transform(F.array(weights), lambda w: sum((added(w, n) for n in grams[1:]), added(w, grams[0]))), 0)
    number = sum((F.greatest(F.lit(0), F.size("h") - n + 1) for n in grams[1:]), F.greatest(F.lit(0), F.size("h") - grams[0] + 1))
    return F.try_divide(total, number) / UNIT


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """Ids of documents labelled good, ``limit`` at most, the same ones at every run."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    grams: tuple[int, ...] = (1, 2),
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document with the base measures, base_failed, the mean log ratio and kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = stored(gram_counts(docs, trusted_ids(labels), grams, buckets), "buckets")
    weights = ratio_weights(counts, buckets, smoothing)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = measured(docs).withColumn("w", weights.scalar()).withColumn("log_ratio", F.coalesce(mean_ratio(F.col("w"), grams, buckets), F.lit(0.0)))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("log_ratio") >= threshold)).alias("kept"), "log_ratio",
    )

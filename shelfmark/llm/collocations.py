"""Phrase collocation mining with double-array tries that numpy walks from all positions of a text.

Texts are tokenised once (``word_blocks``): words that are frequent in their language become codes, all others end a
phrase, as no frequent phrase can hold one. Then, level by level:

1. Candidates. A phrase of k words can be frequent only if its first and its last k - 1 words are. All positions whose
   states in the trie of level k - 1 accept at both ends give such phrases; a task counts its own, and their counts, up
   to the least that is asked for, are added by key. What reaches it is a candidate; no frequent phrase is lost.
2. Counts. The candidates of all levels go into double-array tries, which are broadcast a portion at a time (a portion's
   size is checked, and it is halved if its arrays are too large). The states of all positions advance together, a level
   at a time; accepting states are counted by ``bincount``, and the counts of all tasks are added.

Scores and the ranking are DataFrame steps in decimal arithmetic, which is exact.

Defined results: a null text is empty, a null language is ``und``; repeated rows count as often as they stand; ties go
by score, occurrences, then the phrase's bytes; an empty table gives an empty result; extra columns are ignored; texts
and words of any length are read whole, in blocks that overlap by three words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import parts
from shelfmark.llm.double_array import DoubleArray
from shelfmark.llm.hot import join_one
from shelfmark.llm.shared import stored
from shelfmark.llm.word_blocks import coded_blocks, language_sizes, packed, power_of_two, text_blocks

WORDS, LEAST, FIRST, SCALE, SHARE = 4, 30, 2000, 2_000_000, 80
#: Phrases in a portion, and places in its arrays (12 bytes each).
PORTION, PLACES = 500_000, 1 << 24
#: Counted keys that a task holds before it hands them on, and words of the texts for each part of the sums.
HELD, PART_WORDS = 1 << 20, 1 << 21
#: Phrases whose counts are added up in one array.
SLICE = 1 << 14


class _Counts:
    """Counts by 64-bit key of one block or a few; whoever fills it takes them out once it is ``full``."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)

    @property
    def full(self) -> bool:
        return self.size > HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = self.keys, self.counts
        self.__init__()
        if len(keys) < 2:
            return (keys[0], counts[0]) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        held, inside = np.unique(np.concatenate(keys), return_inverse=True)
        return held, np.bincount(inside, np.concatenate(counts), len(held)).astype(np.int64)


def portions(phrases: DataFrame, width: int) -> Iterator[tuple[np.ndarray, DoubleArray]]:
    """The rows of ``phrases`` (column ``p``: codes) as arrays of ``width`` codes and their tries, a portion at a time.

    A portion is what one hash of the first two codes gives, so equal phrases meet in one portion only. Its arrays are
    bounded by halving it until they are small enough.
    """
    n = phrases.count()
    parts_ = power_of_two(n / PORTION, 1 << 16) if n else 0
    codes = [F.coalesce(F.get("p", i), F.lit(0)).alias(f"w{i}") for i in range(width)]
    rows = phrases.select(F.pmod(F.xxhash64(F.get("p", 0), F.get("p", 1)), F.lit(max(1, parts_))).alias("portion"), *codes)
    for number in range(parts_):
        table = rows.where(F.col("portion") == number).drop("portion").toArrow()
        left = [np.stack([c.to_numpy() for c in table.columns], 1).astype(np.int32)] if table.num_rows else []
        while left:
            block = left.pop()
            trie = DoubleArray(block)
            if len(trie.check) > max(PLACES, int(block.max()) + 2) and len(block) > 1:
                left += [block[: len(block) // 2], block[len(block) // 2 :]]
            else:
                yield block, trie


def candidates(coded: DataFrame, before: DataFrame | None, k: int, least: int, n_parts: int) -> DataFrame:
    """Phrases of ``k`` words (column p) that stand ``least`` times or more; ``before``: those of k - 1 words (None for 2)."""
    spark = coded.sparkSession

    def dealt_counts(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = (mixed(keys) % np.uint64(n_parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(n_parts + 1))
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                own = order[a:b]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([p], pa.int32()), "keys": [packed(keys[own], np.int64)], "counts": [packed(np.minimum(n[own], least), np.int32)],
                })

    def counted(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, trie = _Counts(), shared.value[1] if shared else None
            whole = shared.value[2] if shared else True
            for batch in parts(batches, 1):
                codes = np.frombuffer(batch.column("codes")[0].as_py(), np.int32)
                stop = len(codes) - batch.column("tail")[0].as_py()
                if trie is None:
                    accepted = np.where(codes > 0, codes, -1)
                else:
                    accepted = np.full(len(codes), -1, np.int32)
                    for at, found in trie.walk(codes, k - 1):
                        pass
                    accepted[at] = found
                at = np.flatnonzero(accepted[: len(codes) - k + 1] >= 0) if len(codes) >= k else np.zeros(0, int)
                at = at[at < stop]
                fits = codes[at + k - 1] > 0
                if whole:  # the last k - 1 words must be frequent as well
                    fits &= accepted[at + 1] >= 0
                at = at[fits]
                counts.add(accepted[at].astype(np.int64) << 32 | codes[at + k - 1])
                if counts.full:
                    yield from dealt_counts(*counts.take())
            yield from dealt_counts(*counts.take())

        return run

    def summed(shared):
        def frequent(held: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            keys, inside = np.unique(np.concatenate([np.frombuffer(x[0], np.int64) for x in held]), return_inverse=True)
            n = np.bincount(inside, np.concatenate([np.frombuffer(x[1], np.int32) for x in held]), len(keys))
            keys = keys[n >= least]
            head, last = (keys >> 32).astype(np.int64), (keys & 0xFFFFFFFF).astype(np.int32)
            first = shared.value[0][head] if shared else head[:, None].astype(np.int32)
            rows = np.concatenate([first, last[:, None]], 1)
            for a in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pydict({"p": pa.array(rows[a : a + 10_000].tolist(), pa.list_(pa.int32()))})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, now = [], None
            for batch in parts(batches, 16):
                for part, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "counts"))):
                    if part != now and held:
                        yield from frequent(held)
                        held = []
                    now = part
                    held.append((keys, counts))
            if held:
                yield from frequent(held)

        return run

    def level(shared) -> DataFrame:
        each = coded.mapInArrow(counted(shared), "part int, keys binary, counts binary")
        dealt = each.repartition(n_parts, "part").sortWithinPartitions("part")
        return stored(dealt.mapInArrow(summed(shared), "p array<int>"), f"phrases{k}")

    if before is None:
        return level(None)
    found, tries = None, iter(portions(before, k - 1))
    current = next(tries, None)
    while current is not None:
        following = next(tries, None)
        shared = spark.sparkContext.broadcast((*current, found is None and following is None))
        one = level(shared)
        shared.destroy()
        found = one if found is None else found.unionByName(one)
        current = following
    return before.limit(0) if found is None else found


def mixed(keys: np.ndarray) -> np.ndarray:
    from shelfmark.llm.shingles import mix

    return mix(keys.astype(np.uint64))


def occurrences(coded: DataFrame, phrases: DataFrame, width: int) -> DataFrame:
    """How often each phrase (column p) stands in the texts: p, a."""
    spark = coded.sparkSession

    def counting(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, trie = shared.value
            n = np.zeros(len(rows), np.int64)
            for batch in parts(batches, 1):
                codes = np.frombuffer(batch.column("codes")[0].as_py(), np.int32)
                stop = len(codes) - batch.column("tail")[0].as_py()
                for at, found in trie.walk(codes, width):
                    n += np.bincount(found[(found >= 0) & (at < stop)], minlength=len(rows))
            for number, a in enumerate(range(0, len(n), SLICE)):
                if len(seen := np.flatnonzero(n[a : a + SLICE])):  # no more than the positions of the task's texts
                    yield pa.RecordBatch.from_pydict({
                        "slice": pa.array([number], pa.int32()), "seen": [packed(seen, np.int32)], "n": [packed(n[a : a + SLICE][seen], np.int64)],
                    })

        return run

    def adding(shared):
        def added(number: int, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows = shared.value[0][number * SLICE : number * SLICE + SLICE]
            seen = np.flatnonzero(n)
            for a in range(0, len(seen), 10_000):
                own = seen[a : a + 10_000]
                p = [[w for w in row if w] for row in rows[own].tolist()]
                yield pa.RecordBatch.from_pydict({"p": pa.array(p, pa.list_(pa.int32())), "a": pa.array(n[own], pa.int64())})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, n = None, None
            for batch in parts(batches, 16):
                for row in batch.to_pylist():
                    if row["slice"] != now:
                        if now is not None:
                            yield from added(now, n)
                        now, n = row["slice"], np.zeros(SLICE, np.int64)
                    n[np.frombuffer(row["seen"], np.int32)] += np.frombuffer(row["n"], np.int64)
            if now is not None:
                yield from added(now, n)

        return run

    found = None
    for rows, trie in portions(phrases, width):
        shared = spark.sparkContext.broadcast((rows, trie))
        shards = coded.mapInArrow(counting(shared), "slice int, seen binary, n binary")
        dealt = shards.repartition(-(-len(rows) // SLICE), "slice").sortWithinPartitions("slice")
        one = stored(dealt.mapInArrow(adding(shared), "p array<int>, a long"), "occurrences")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    return phrases.select("p", F.lit(0).cast("long").alias("a")).limit(0) if found is None else found


def mine_collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, first: int | None = FIRST, share: int = SHARE) -> DataFrame:
    """The best phrases of 2 to ``words`` (4 at most) words of each language (see the module): lang, rank, phrase, a, l, r, n, score.

    A phrase stands ``least`` times or more. Its score is the smallest floor(2000000 a / (l + r)) over its cuts. Phrases
    within a longer one that stands at least ``share`` times in a hundred of theirs are dropped. ``first``: phrases given
    for each language (None: all).
    """
    if not 2 <= words <= 4:
        raise ValueError("words must be 2, 3 or 4")
    blocks = text_blocks(docs)
    sizes = language_sizes(blocks)
    vocabulary, coded = coded_blocks(blocks, least)
    total = coded.agg(F.sum(F.length("codes") / 4)).first()[0] or 0
    n_parts = max(32, power_of_two(total / PART_WORDS, 1 << 16))
    found, before = None, None
    for k in range(2, words + 1):
        before = candidates(coded, before, k, least, n_parts)
        found = before if found is None else found.unionByName(before)
    counts = occurrences(coded, found, words)
    single = vocabulary.select(F.array("code").alias("p"), F.col("n").alias("a"))
    parts_ = counts.unionByName(single).select(F.col("p").alias("q"), F.col("a").alias("f"))

    size = F.size("p")
    cut = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    ends = counts.select("p", "a", cut).select("p", "a", "k", F.slice("p", 1, F.col("k")).alias("head"), F.slice("p", F.col("k") + 1, size - F.col("k")).alias("rest"))
    left = join_one(ends.withColumnRenamed("head", "q"), parts_, "q", hot=[]).select("p", "a", "k", F.col("f").alias("l"), "rest")
    both = left.withColumnRenamed("rest", "q").join(parts_, "q").select("p", "a", "k", "l", F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = both.withColumn("score", score).groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))

    # Spans of each longer candidate, with the most occurrences of any that holds them.
    lengths = F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("p", i, n)))
    longer = counts.where(size > 2).select(F.explode(F.array_distinct(F.flatten(lengths))).alias("p"), F.col("a").alias("most"))
    covered = longer.groupBy("p").agg(F.max("most").alias("most"))
    kept = best.join(covered, "p", "left").where(F.col("most").isNull() | (F.lit(100) * wide("most") < F.lit(share) * wide("a")))
    kept = stored(kept.select("p", "a", "c.score", "c.l", "c.r"), "scored")

    # Codes back to words. A code is in one language, so the first one tells the phrase's.
    spelled = kept.select("p", F.posexplode("p").alias("i", "code"))
    spelled = join_one(spelled, vocabulary.select("code", "lang", "word"), "code")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
    named = spelled.groupBy("p").agg(text.alias("phrase"), F.first("lang").alias("lang"))
    rows = kept.join(named, "p").join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang")
    order = "score desc, a desc, phrase"
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    if first is not None:  # no more than 64 times as many rows meet in the order of a language
        salted = salted.withColumn("rank", F.expr(f"row_number() over (partition by lang, salt order by {order})")).where(F.col("rank") <= first)
    ranked = salted.withColumn("rank", F.expr(f"row_number() over (partition by lang order by {order})"))
    ranked = ranked if first is None else ranked.where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))

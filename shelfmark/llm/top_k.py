"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are integers: floor(scale * x) of every component. Equal rows are counted first, then candidates are dealt into
blocks by a hash of their id and vector. A block's components are split into a quantised impact (the nearest multiple
of a step) and a rest. A posting segment holds the candidates with one impact in one dimension. A query takes the
segments by descending |query component * impact| and adds them to the candidates' accumulators. What unread segments
and rests can still add bounds every score from both sides, so candidates whose upper bound is under the k-th largest
lower bound are proven to be out; the rest are rescored exactly as soon as they are few, or when all segments are read.

Every query first meets one block. Its k-th best score there is the floor with which it goes to all other blocks: a
block none of whose candidates can reach it is left at once. A block's index is built once, and all queries pass it a
batch at a time, so a task holds a block and a batch. Each block returns k rows a query at most, and a ranking over
these gives the k best.

Defined results: vectors that are null or hold a null or non-finite component take no part, as query or candidate;
empty vectors score 0; of vectors of unequal lengths the shorter counts as padded with zeros; products are summed
exactly, as Python integers where 64 bits might not hold them; components and scores beyond 64 bits are given, and
ranked, as the nearest 64-bit number; ties go to the smaller id; rows that repeat an id are candidates of their own,
but no candidate has the query's id; of query rows that repeat an id one counts, that with the smallest vector; fewer
candidates than k are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.batches import parts, small_batches
from shelfmark.llm.shared import stored

SCALE = 1024
#: Impacts between zero and the bulk of a block's largest components.
LEVELS = 16
#: Vectors in a block of candidates; queries taken together.
BLOCK, QUERY_BLOCK = 8192, 2048
#: Segments between two tests of the proof; it ends the search once so many times k candidates are left to rescore.
RUN, ENOUGH = 256, 8
#: Share of a product of lengths that is more than what floating-point sums can be off by.
ROUNDING = 1e-9
#: Sums below this are exact in 64 bits.
SAFE, LARGEST = 1 << 62, (1 << 63) - 1
RESULT_SCHEMA = "query_id long, vec_id long, score long"


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=-1))


class ImpactIndex:
    """Posting segments of a block of integer vectors, by dimension and quantised impact."""

    def __init__(self, vectors: np.ndarray, step: int | None = None):
        self.vectors = vectors
        sizes = np.abs(vectors.astype(np.float64))
        if step is None:
            step = max(1, int(np.quantile(sizes, 0.99)) // LEVELS) if vectors.size else 1
        impacts = vectors // step + (vectors % step > step // 2)
        rests = vectors.astype(np.float64) - impacts.astype(np.float64) * step
        #: By Cauchy and Schwarz, what a candidate's rests add to a score is at most this times the query's length.
        self.rest_lengths = _lengths(rests) + ROUNDING * _lengths(vectors)
        self.largest = int(sizes.max(initial=0)) + 1
        owners, values, dims = [], [], []
        for d in range(vectors.shape[1]):
            order = np.argsort(impacts[:, d], kind="stable")
            found, starts = np.unique(impacts[order, d], return_index=True)
            for value, segment in zip(found, np.split(order, starts[1:])):
                if value:
                    owners.append(segment)
                    values.append(float(value) * step)
                    dims.append(d)
        self.owners = owners
        self.values, self.dims = np.array(values, np.float64), np.array(dims, np.int64)
        self.sizes = np.array([len(segment) for segment in owners], np.int64)

    def search(self, query: np.ndarray, k: int, banned: np.ndarray | None = None, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the best ``k`` and reach ``floor``, without the ``banned`` ones, and their exact scores."""
        near = query.astype(np.float64)
        impact = near[self.dims] * self.values if len(self.dims) else np.zeros(0)
        order = np.argsort(-np.abs(impact), kind="stable")
        order = order[impact[order] != 0]
        impact, sizes = impact[order], self.sizes[order] if len(order) else order
        gain, loss = (_left(np.maximum(sign * impact, 0), self.dims[order]) * (1 + ROUNDING) for sign in (1, -1))
        slack = self.rest_lengths * (_lengths(near) * (1 + ROUNDING)) + 1
        scores, rows = np.zeros(len(self.vectors)), np.arange(len(self.vectors))
        if banned is not None:
            rows = np.delete(rows, banned)
        least = -np.inf if floor is None else floor - abs(floor) * ROUNDING
        for end in [*range(0, len(order), RUN), len(order)]:
            if end:
                run = slice((end - 1) // RUN * RUN, end)
                owners = np.concatenate([self.owners[segment] for segment in order[run]])
                scores += np.bincount(owners, np.repeat(impact[run], sizes[run]), len(scores))
            if len(rows) > k:
                low = scores[rows] - slack[rows] - loss[end]
                least = max(least, np.partition(low, len(low) - k)[len(low) - k])
            rows = rows[scores[rows] + slack[rows] + gain[end] >= least]
            if len(rows) <= ENOUGH * k:
                break
        return rows, self.exact(rows, query)

    def exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        largest = max(abs(int(query.max(initial=0))), abs(int(query.min(initial=0))))
        if self.largest * largest * max(1, len(query)) < SAFE:
            return self.vectors[rows] @ query
        whole = [sum(a * b for a, b in zip(v, query.tolist())) for v in self.vectors[rows].tolist()]
        return np.array([max(-LARGEST, min(LARGEST, s)) for s in whole], np.int64)


def _left(amounts: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """For each position, the sum over dimensions of the largest amount from there on."""
    # Amounts of a dimension fall along the order, so its largest one from a position on is its next one.
    left, best, total = np.zeros(len(amounts) + 1), {}, 0.0
    for i in range(len(amounts) - 1, -1, -1):
        d, amount = int(dims[i]), float(amounts[i])
        if amount > best.get(d, 0.0):
            total += amount - best.get(d, 0.0)
            best[d] = amount
        left[i] = total
    return left


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(1, sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _fitted(matrix: np.ndarray, width: int) -> np.ndarray:
    """``matrix`` with ``width`` columns."""
    if matrix.shape[1] >= width:
        return matrix[:, :width]
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def quantised(vectors: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """Usable rows of ``vectors`` as (vec_id, v), v an array of floors."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    usable = F.col(vector_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    # Doubles of 2**63 and more are no 64-bit numbers.
    edge = float(1 << 63)
    floors = lambda e: F.when(e * scale >= edge, F.lit(LARGEST)).when(e * scale <= -edge, F.lit(-LARGEST)).otherwise(F.floor(e * scale))
    return vectors.where(F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, floors).alias("v"))


def _searched(blocks: DataFrame, asked: DataFrame, k: int, n_blocks: int, together: int) -> DataFrame:
    """query_id, vec_id, score: per query (b, vec_id, v, floor) and block b of candidates (b, vec_id, v, copies), its best."""
    null = F.lit(None).cast("long")
    rows = blocks.select("b", F.lit(False).alias("asks"), "vec_id", "v", "copies", null.alias("floor"))
    rows = rows.unionByName(asked.select("b", F.lit(True).alias("asks"), "vec_id", "v", null.alias("copies"), "floor"))
    dealt = rows.repartition(n_blocks, "b").sortWithinPartitions("b", "asks")

    def answers(index: ImpactIndex, ids: np.ndarray, copies: np.ndarray, ask: pa.RecordBatch) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        found: list[list[np.ndarray]] = [[], [], []]
        queries = _fitted(_matrix(ask.column("v")), index.vectors.shape[1])
        for query_id, query, floor in zip(ask.column("vec_id").to_pylist(), queries, ask.column("floor").to_pylist()):
            a, b = np.searchsorted(ids[order], [query_id, query_id + 1])
            at, scores = index.search(query, k, order[a:b], floor)
            best = np.lexsort((ids[at], -scores))[:k]
            best = np.repeat(best, np.minimum(copies[at[best]], k))[:k]
            for column, values in zip(found, (np.full(len(best), query_id), ids[at[best]], scores[best])):
                column.append(values)
        columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in found]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index = None, [], None
        for batch in parts(batches, together):
            b = batch.column("b").to_numpy()
            mark = 2 * b + batch.column("asks").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
            for start, end in zip(edges, edges[1:]):
                part = batch.slice(start, end - start)
                if b[start] != block:
                    block, held, index = b[start], [], None
                if not mark[start] % 2:
                    held.append(part)
                elif held or index:
                    if index is None:
                        own = pa.Table.from_batches(held).combine_chunks()
                        index = ImpactIndex(_matrix(own.column("v").chunk(0)))
                        ids, copies = own.column("vec_id").to_numpy(), own.column("copies").to_numpy()
                        held = []
                    yield answers(index, ids, copies, part)

    return dealt.mapInArrow(run, RESULT_SCHEMA)


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    vector_col: str = "embedding",
    scale: int = SCALE,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries``, its ``k`` best rows of ``vectors``."""
    small_batches(vectors.sparkSession, query_block)
    own = quantised(vectors, vector_col, scale).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    own = stored(own, "vectors")
    n_blocks = max(1, -(-own.count() // block))  # how many blocks there are follows the number of rows
    candidates = own.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int"))
    asked = stored(quantised(queries, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    first = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    at_first = asked.withColumn("b", first).withColumn("floor", F.lit(None).cast("long"))
    best = stored(_searched(candidates, at_first, k, n_blocks, query_block), "first")
    if n_blocks > 1:
        floors = best.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        floors = floors.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") == k, F.col("least")).alias("floor"))
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda b: b != first))
        rest = asked.join(floors, "vec_id", "left").withColumn("b", others)
        best = best.unionByName(_searched(candidates, rest, k, n_blocks, query_block))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

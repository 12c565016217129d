"""Meetings of classes of alike products: lists of a block's classes meet, and numpy scores them.

Within a list, classes of equal letters share a title's similarity, so letters are compared once for each two different
titles. Only what can reach a probe's bound is compared further: the threshold, or a score that the probe has for sure.
"""

from __future__ import annotations

import json
import math
import string
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import exprs as X
from shelfmark.sources.shared import light_batches, stored

#: Classes of a list, and their rows if they travel with them.
LIST, LIST_ROWS = 8_000, 40_000
#: Rows of a class that travel together.
CHUNK = 500
#: Meetings that are held at a time.
AT_ONCE = 1 << 17
#: How far scores may be from each other before they are rounded to six digits.
SLACK = 1e-6
#: The characters of normalised titles, and how many of a letter are bits; later ones are counted.
LETTERS, DEPTH = string.ascii_lowercase + string.digits + "-", 4
#: Weights of title, brand, price, category and attributes.
WEIGHTS = {"dedup": (0.40, 0.20, 0.30, 0.10, 0.0), "entity": (0.35, 0.2, 0.25, 0.1, 0.1)}


def _lists(kinds: DataFrame, side: Column, gate: float, fields: list[str], rows: Column | None, *more: Column) -> DataFrame:
    """The classes of each block and level of prices as lists of a bounded length: block, level, one (an id), list."""
    level = F.when((F.col("price") > 0) & (F.col("price") < float("inf")), F.floor(F.log("price") / -math.log(1 - gate)))
    of = kinds.withColumn("block", F.explode(F.array_distinct(side))).where("block is not null").withColumn("level", level)
    each = of.select("block", "level", F.struct(*fields, *more).alias("entry"), F.lit(1).alias("n") if rows is None else rows.alias("n"))
    # Long lists are cut by letters, so that equal titles stay together; of one title's many, by class.
    titles = each.groupBy("block", "level", F.col("entry.look").alias("look")).agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    share = lambda k, n: F.ceil(F.greatest(k / LIST, n / LIST_ROWS))
    blocks = titles.groupBy("block", "level").agg(share(F.sum("k"), F.sum("n")).alias("chunks")).where("chunks > 1")
    long = titles.withColumn("parts", share(F.col("k"), F.col("n"))).where("parts > 1").select("block", "level", "look", "parts")
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    each = each.withColumn("look", F.col("entry.look"))
    dealt = each.join(blocks, same(each, blocks, "block", "level"), "left").select(each["*"], "chunks")
    dealt = dealt.join(long, same(dealt, long, "block", "level", "look"), "left").select(dealt["*"], "parts")
    chunk = F.pmod(F.xxhash64("look"), F.coalesce("chunks", F.lit(1)))
    part = F.pmod(F.xxhash64("entry.class", "n"), F.coalesce("parts", F.lit(1)))
    lists = dealt.groupBy("block", "level", chunk.alias("chunk"), part.alias("part")).agg(F.collect_list("entry").alias("list"))
    return lists.select("block", "level", "list", F.concat_ws("|", "chunk", "part", F.coalesce(F.col("level").cast("string"), F.lit("-"))).alias("one"))


def firsts(rows: DataFrame) -> DataFrame:
    """The first row of each class and its first of another source: class, firsts."""
    each = rows.groupBy("class", "sourceId").agg(F.min("id").alias("id"))
    two = each.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy("id", "sourceId"))).where("rank <= 2")
    return two.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("id", "sourceId"))).alias("firsts"))


def members(rows: DataFrame) -> DataFrame:
    """The rows of each class in lists of about ``CHUNK``: class, members."""
    sizes = rows.groupBy("class").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).where("chunks > 1")
    dealt = rows.select("class", "id", "sourceId").join(sizes, "class", "left").withColumn("chunk", F.pmod(F.xxhash64("id", "sourceId"), F.coalesce("chunks", F.lit(1))))
    return dealt.groupBy("class", "chunk").agg(F.collect_list(F.struct("id", "sourceId")).alias("members")).drop("chunk")


def sure(kinds: DataFrame, score, gate: float) -> DataFrame:
    """``kinds`` (with ``firsts``) with ``bound``: a score that each row of a class reaches with a row of another source.

    That is the class's own score, if it has several sources, or that of the next cheaper or dearer one that is alike but
    for its price. Only ones without a SKU count, as two SKUs may not match.
    """
    alike = Window.partitionBy("tokens", "brand", "category", *[c for c in ("names", "said") if c in kinds.columns])
    free = F.when(F.col("sku").isNull(), F.struct("price", "firsts"))
    last = lambda *order: F.last(free, ignorenulls=True).over(alike.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    before, after = last("price", "class"), last(F.desc("price"), F.desc("class"))
    rows = kinds.withColumns({"before": before, "after": after})
    several = lambda f: F.size(f) > 1

    def reached(price, other):
        gap = X.price_gap(F.col("price"), price)
        return F.when(other & F.coalesce(gap <= gate, F.lit(True)), score(price))

    other = lambda b: b.isNotNull() & (several(b["firsts"]) | (~several(F.col("firsts")) & (F.get(b["firsts"], 0)["sourceId"] != F.get("firsts", 0)["sourceId"])))
    own = reached(F.col("price"), several(F.col("firsts")) & F.col("sku").isNull())
    near = [reached(F.col(f"{s}.price"), other(F.col(s))) for s in ("before", "after")]
    return rows.withColumn("bound", F.greatest(own, *near, F.lit(0.0))).drop("before", "after")


def meet(probes: DataFrame, others: DataFrame, probe: Column, keys: Column, form: str, threshold: float, gate: float, out: str, one_sku: bool, parts: int) -> DataFrame:
    """What meetings of classes give by block: every probe meets all classes that carry one of its keys, each once.

    ``form`` names the score. ``out`` says what is given: "pairs" of rows (id, match, score), from the ``members`` of each
    class; "best", which holds for each class of probes the first rows of its best matches of two sources (class_a, sourceId,
    s, id), from ``bound`` and ``firsts``; or "classes" (class_a, class_b, score).
    """
    light_batches(probes.sparkSession)
    look = F.array_join(F.transform("marks", lambda m: F.element_at(F.array(*[F.lit(c) for c in LETTERS]), F.shiftright(m, 24) + 1)), "").alias("look")
    none, word = F.array().cast("array<string>"), F.col("block").startswith("t|")
    told = F.to_json(F.struct("names", "said")).alias("told") if form == "entity" else F.lit("").alias("told")
    carried = {"pairs": ["members"], "best": ["firsts"], "classes": []}[out]
    rows = F.size("members") if out == "pairs" else None
    fields = ["class", "look", "price", "brand", "category", "sku", "told"]
    probes, others = (df.withColumns({"look": look, "told": told}) for df in (probes, others))
    # Pairs that meet by several words count at the first of them; letters in common only where brands differ.
    ahead = F.when(word, F.slice("tokens", 1, F.greatest(F.array_position("tokens", F.substring("block", 3, 1 << 20)) - 1, F.lit(0)).cast("int"))).otherwise(none)
    unlike = F.col("block").startswith(F.concat(F.lit("c:"), "category", F.lit("|l|")))
    bound = (F.col("bound") if out == "best" else F.lit(0.0)).alias("bound")
    mine = _lists(probes, probe, gate, [*fields, *(carried if out == "pairs" else [])], rows, bound, unlike.alias("unlike"), ahead.alias("ahead"))
    theirs = _lists(others, keys, gate, [*fields, *carried], rows, F.when(word, F.col("tokens")).otherwise(none).alias("words"))
    # Lists are told to each other by their names alone, and travel once for each list that they meet.
    index = lambda df, s: df.select("block", F.col("level").alias(f"level_{s}"), F.col("one").alias(f"one_{s}"))
    levels = F.col("level_a").isNull() | F.col("level_b").isNull() | (F.abs(F.col("level_a") - F.col("level_b")) <= 1)
    mine, theirs = stored(mine, "lists"), stored(theirs, "lists")
    met = index(mine, "a").join(index(theirs, "b"), "block").where(levels).select("block", "one_a", "one_b")
    met = met.join(theirs.select("block", F.col("one").alias("one_b"), F.col("list").alias("b")), ["block", "one_b"])
    met = met.repartition(parts, "block", "one_a").join(mine.select("block", F.col("one").alias("one_a"), F.col("list").alias("a")), ["block", "one_a"]).select("a", "b")
    schema = {"pairs": "id string, match string, score double", "best": "class_a string, sourceId string, s double, id string", "classes": "class_a string, class_b string, score double"}[out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _Tiles(batch, form, threshold, gate, one_sku, out).found():
                yield found

    return met.mapInArrow(run, schema)


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Two arrays of texts as numbers that are equal where texts are, -1 for none, and the texts by number."""
    both = pa.concat_arrays([a, b]).dictionary_encode()
    codes = both.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return codes[: len(a)], codes[len(a) :], both.dictionary


def _portions(counts: np.ndarray) -> Iterator[slice]:
    """Slices of ``counts`` that add up to ``AT_ONCE`` at most, or are one number."""
    ends, start = np.cumsum(counts), 0
    while start < len(counts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
        yield slice(start, stop)
        start = stop


def _ragged(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of the ranges that begin at ``first``, with the place of its range."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def _rounded(x: np.ndarray) -> np.ndarray:
    """``x`` rounded half up to six digits, as Spark's ``round`` does it on a number's text."""
    scaled = x * 1e6
    low = np.floor(scaled)
    over = scaled - low
    out = (low + (over >= 0.5)) / 1e6
    for i in np.flatnonzero(np.abs(over - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


class _Tiles:
    """The meetings of a batch of rows, each of two lists."""

    def __init__(self, batch: pa.RecordBatch, form: str, threshold: float, gate: float, one_sku: bool, out: str):
        self.form, self.threshold, self.gate, self.one_sku, self.out = form, threshold, gate, one_sku, out
        sides = [batch.column(batch.schema.get_field_index(c)) for c in "ab"]
        tiles = [np.repeat(np.arange(len(s)), s.value_lengths().to_numpy(zero_copy_only=False)) for s in sides]
        a, b = (s.flatten() for s in sides)
        field = lambda name: (a.field(name), b.field(name))
        *looks, texts = _codes(*field("look"))
        self._letters(texts)
        # Both sides in the order of tile, length and letters; ``told`` are codes of texts.
        self.order = [np.lexsort((k, self.length[k], t)) for k, t in zip(looks, tiles)]
        sort = lambda pair: [x[o] for x, o in zip(pair, self.order)]
        self.look, self.tile = sort(looks), sort(tiles)
        coded = {c: _codes(*field(c)) for c in ("brand", "category", "sku", "told")}
        self.code = {c: sort(v[:2]) for c, v in coded.items()}
        self.attributes, self.alike = [json.loads(t) if t else {} for t in coded["told"][2].to_pylist()], {}
        self.blank = next((i for i, t in enumerate(coded["category"][2].to_pylist()) if t == ""), -2)
        prices = field("price")
        self.unpriced = sort([p.is_null().to_numpy(zero_copy_only=False) for p in prices])
        self.price = sort([p.fill_null(0.0).to_numpy(zero_copy_only=False) for p in prices])
        self.bound = np.maximum(a.field("bound").to_numpy(zero_copy_only=False)[self.order[0]], threshold)
        self.unlike = a.field("unlike").fill_null(False).to_numpy(zero_copy_only=False)[self.order[0]]
        self.ahead, self.words = a.field("ahead"), b.field("words")
        self.late = (self.ahead.value_lengths().to_numpy(zero_copy_only=False) > 0)[self.order[0]]
        self.a, self.b = a, b
        self.held = None

    def _letters(self, texts: pa.Array) -> None:
        """Of each title its length, words of a bit for each letter that occurs 1 to DEPTH times, and what is beyond."""
        said = texts.to_pylist()
        self.length = np.array([len(t) for t in said], np.int64)
        places = np.array([LETTERS.find(chr(i)) for i in range(128)])
        letters = places[np.frombuffer("".join(said).encode(), np.uint8)]
        counts = np.bincount(np.repeat(np.arange(len(said)), self.length) * len(LETTERS) + letters, minlength=len(said) * len(LETTERS)).reshape(-1, len(LETTERS))
        bits = np.uint64(1) << np.arange(len(LETTERS), dtype=np.uint64)
        self.bits = [((counts > j) * bits).sum(1, dtype=np.uint64) for j in range(DEPTH)]
        self.beyond = np.maximum(counts - DEPTH, 0)
        self.deep = self.beyond.any(1)

    def _titles(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Similarity of titles by their numbers."""
        shared = np.bitwise_count(self.bits[0][a] & self.bits[0][b]).astype(np.int64)
        for word in self.bits[1:]:
            shared += np.bitwise_count(word[a] & word[b])
        deep = np.flatnonzero(self.deep[a] & self.deep[b]) if self.deep.any() else []
        if len(deep):
            shared[deep] += np.minimum(self.beyond[a[deep]], self.beyond[b[deep]]).sum(1)
        return shared / np.maximum(np.maximum(self.length[a], self.length[b]), 1)

    def _needed(self) -> np.ndarray:
        """The least similarity of titles that lets each probe reach its bound."""
        title, brand, price, category, attributes = WEIGHTS[self.form]
        half = lambda no: np.where(no, 0.5, 1.0)
        rest = brand * half(self.code["brand"][0] < 0) + category * half(self.code["category"][0] == self.blank) + price * half(self.unpriced[0]) + attributes
        needed = (self.bound - 3 * SLACK - rest) / title
        return needed if self.one_sku else np.where(self.code["sku"][0] >= 0, -1.0, needed)  # equal SKUs match whatever the title

    def _meetings(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of probes and others, with the similarity of their titles, that can reach the probe's bound."""
        if not len(self.tile[0]) or not len(self.tile[1]):
            return
        starts = [np.flatnonzero(np.r_[True, (np.diff(t) != 0) | (np.diff(k) != 0)]) for t, k in zip(self.tile, self.look)]
        counts = [np.diff(np.r_[s, len(t)]) for s, t in zip(starts, self.tile)]
        needed = self._needed()
        least = np.minimum.reduceat(needed, starts[0])
        (ka, kb), (ta, tb) = ([x[s] for x, s in zip(pair, starts)] for pair in (self.look, self.tile))
        # Of other titles only those of a fitting length.
        most, length = self.length.max() + 2, self.length[ka]
        with np.errstate(divide="ignore"):
            low = np.where(least > 0, np.ceil(least * length - SLACK), 0).astype(np.int64)
            high = np.where(least > 0, np.minimum(np.floor(length / np.maximum(least, 1e-9) + SLACK), most - 1), most - 1).astype(np.int64)
        place = tb * most + self.length[kb]
        first = np.searchsorted(place, ta * most + np.minimum(low, most - 1), "left")
        number = np.maximum(np.searchsorted(place, ta * most + high, "right") - first, 0)
        for part in _portions(number):
            of, other = _ragged(first[part], number[part])
            of += part.start
            titles = self._titles(ka[of], kb[other])
            able = np.flatnonzero(titles >= least[of])
            of, other, titles = of[able], other[able], titles[able]
            for rows in _portions(counts[0][of]):
                at, probe = _ragged(starts[0][of[rows]], counts[0][of[rows]])
                title, met = titles[rows][at], other[rows][at]
                able = np.flatnonzero(title >= needed[probe])
                probe, title, met = probe[able], title[able], met[able]
                for each in _portions(counts[1][met]):
                    at, place_b = _ragged(starts[1][met[each]], counts[1][met[each]])
                    yield probe[each][at], place_b, title[each][at]

    def _scored(self, a: np.ndarray, b: np.ndarray, title: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The meetings whose score reaches the probe's bound, with their scores."""
        w = WEIGHTS[self.form]
        pa_, pb = self.price[0][a], self.price[1][b]
        known = ~(self.unpriced[0][a] | self.unpriced[1][b])
        most = np.maximum(pa_, pb)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.abs(pa_ - pb) / most
        brand_a, brand_b = self.code["brand"][0][a], self.code["brand"][1][b]
        keep = ~known | (most == 0) | (gap <= self.gate)
        keep &= ~(self.unlike[a] & (brand_a == brand_b))
        coded = (self.code["sku"][0][a] >= 0) & (self.code["sku"][1][b] >= 0)
        if self.one_sku:
            keep &= ~coded
        brand = np.where(brand_a == brand_b, np.where(brand_a < 0, 0.5, 1.0), 0.0)
        cat_a, cat_b = self.code["category"][0][a], self.code["category"][1][b]
        category = np.where((cat_a == self.blank) | (cat_b == self.blank), 0.5, np.where(cat_a == cat_b, 1.0, 0.0))
        level = 0.0 if self.form == "dedup" else 1.0  # of prices of which none is above zero
        near = np.where(known, np.maximum(0.0, np.where(most > 0, 1 - gap, level)), 0.5)
        if self.form == "dedup":
            score = title * w[0] + brand * w[1] + near * w[2] + category * w[3]
        else:
            base = title * w[0] + brand * w[1] + near * w[2] + category * w[3]
            able = base + w[4] >= self.bound[a] - 2 * SLACK
            if not self.one_sku:
                able |= coded
            keep = np.flatnonzero(keep & able)
            a, b, coded, base = a[keep], b[keep], coded[keep], base[keep]
            base = base + self._told(self.code["told"][0][a], self.code["told"][1][b]) * w[4]
            score = np.maximum(0.0, np.minimum(1.0, base))
            if not self.one_sku:
                same = self.code["sku"][0][a] == self.code["sku"][1][b]
                score = np.where(coded, np.where(same, 1.0, np.minimum(0.7, base)), score)
            keep = np.ones(len(a), bool)
        score = np.minimum(1.0, score)
        keep = np.flatnonzero(keep & (score >= self.bound[a] - 2 * SLACK))
        a, b, score = a[keep], b[keep], _rounded(score[keep])
        keep = np.flatnonzero(score >= self.threshold)
        a, b, score = a[keep], b[keep], score[keep]
        if self.out != "best" and self.late[a].any():
            # Who met by an earlier word has met.
            ahead, words = (c.take(pa.array(o[x])).to_pylist() for c, o, x in zip((self.ahead, self.words), self.order, (a, b)))
            keep = np.flatnonzero([not set(x) & set(y) for x, y in zip(ahead, words)])
            a, b, score = a[keep], b[keep], score[keep]
        return a, b, score

    def _told(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Similarity of attributes by their numbers: the share of common names with equal values."""
        both, back = np.unique(a * len(self.attributes) + b, return_inverse=True)
        for key in both.tolist():
            if key not in self.alike:
                x, y = (self.attributes[k] for k in divmod(key, len(self.attributes)))
                of = lambda name: set(x.get(name) or ()) & set(y.get(name) or ())
                common = len(of("names"))
                self.alike[key] = len(of("said")) / common if common else 0.5
        return np.array([self.alike[k] for k in both.tolist()])[back] if len(both) else np.zeros(0)

    def found(self) -> Iterator[pa.RecordBatch]:
        give = {"pairs": self._pairs, "best": self._best, "classes": self._classes}[self.out]
        for met in self._meetings():
            a, b, score = self._scored(*met)
            if len(a):
                yield from give(self.order[0][a], self.order[1][b], score)

    def _classes(self, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([self.a.field("class").take(pa.array(a)), self.b.field("class").take(pa.array(b)), pa.array(score)], ["class_a", "class_b", "score"])

    def _held(self, lists: list[pa.Array | None]) -> list[dict]:
        """The rows that lists hold, once for the batch: where those of each list begin, how many, ids and numbers of sources."""
        if self.held is None:
            flat = [x.flatten() if x is not None else None for x in lists]
            none = pa.array([], pa.string())
            source = _codes(*[f.field("sourceId") if f is not None else none for f in flat])
            self.held = []
            for x, f, s in zip(lists, flat, source):
                if x is not None:
                    n = x.value_lengths().to_numpy(zero_copy_only=False)
                    self.held.append({"first": np.cumsum(n) - n, "n": n, "id": f.field("id"), "source": s, "sourceId": f.field("sourceId")})
        return self.held

    def _pairs(self, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of the classes, of different sources."""
        x, y = self._held([self.a.field("members"), self.b.field("members")])
        for part in _portions(x["n"][a] * y["n"][b]):
            of, row_a = _ragged(x["first"][a[part]], x["n"][a[part]])
            of += part.start
            at, row_b = _ragged(y["first"][b[of]], y["n"][b[of]])
            row_a, of = row_a[at], of[at]
            keep = np.flatnonzero(x["source"][row_a] != y["source"][row_b])
            yield pa.record_batch([x["id"].take(pa.array(row_a[keep])), y["id"].take(pa.array(row_b[keep])), pa.array(score[of[keep]])], ["id", "match", "score"])

    def _best(self, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        """For each class of probes the best row, the best of another source than that, and the best second row of its source."""
        held = self._held([None, self.b.field("firsts")])[0]
        one, two = held["first"][b], np.where(held["n"][b] > 1, held["first"][b] + 1, -1)
        if not hasattr(self, "rank"):
            codes, _, texts = _codes(held["id"], pa.array([], pa.string()))
            ranks = np.empty(len(texts), np.int64)
            ranks[pc.sort_indices(texts).to_numpy()] = np.arange(len(texts))
            self.rank = ranks[codes]
        order = np.lexsort((self.rank[one], -score, a))
        a, one, two, score = a[order], one[order], two[order], score[order]
        group = np.cumsum(np.r_[True, np.diff(a) != 0]) - 1
        start = np.flatnonzero(np.r_[True, np.diff(a) != 0])
        other = np.flatnonzero(held["source"][one] != held["source"][one[start]][group])
        again = np.flatnonzero((two >= 0) & (held["source"][one] == held["source"][one[start]][group]))
        again = again[np.lexsort((self.rank[two[again]], -score[again], a[again]))]
        lead = lambda places: places[np.unique(a[places], return_index=True)[1]]
        other, again = lead(other), lead(again)
        row, at = np.r_[one[start], one[other], two[again]], np.r_[start, other, again]
        yield pa.record_batch(
            [self.a.field("class").take(pa.array(a[at])), held["sourceId"].take(pa.array(row)), pa.array(-score[at]), held["id"].take(pa.array(row))], ["class_a", "sourceId", "s", "id"]
        )

"""N-gram Jaccard join: links and components of documents whose shingle sets are similar, exactly.

Two sets link when 100 * |A and B| >= PERCENT * |A or B|. Equal sets are one set from the start. Shingles have a global
order, rare ones first: how many sets hold a shingle is counted over the whole corpus, and shingles of more than a few
sets (at most ``frequent_limit`` of them, else the bar is raised) are ordered behind all others by the size class of
that number. Two sets that link share one of the first n - ceil(PERCENT n / 100) + 1 shingles of either in this order
(prefix filter), so an index list for each such shingle holds every link. The entries of a list that have the same
length of set and the same position in it are one block: where the first shared shingle stands so late that what
follows can't reach the overlap, the two blocks are skipped as a whole (positional and length filter).

Lists of up to FREQUENT_FROM sets give their pairs at once. Longer lists can hold any part of the corpus. For these the
answers are derived from those of a similar set: each list's pivot, the set least changed from the others, is compared
with all others; sets that link with it are one component and need no comparison among each other; for the rest the
distance to the pivot bounds the distance to any other set of the list (triangle inequality of the Jaccard distance),
and only pairs of different components that no bound rules out are compared, in blocks of bounded size.

That tells the components, not all links inside them. Where a component has frequent shingles and not every two of its
sets are known to link, its sets are dealt into blocks of bounded size, by their length and hash, and all pairs of
blocks whose lengths allow links are compared: so each pair is compared once, on the whole sets, and only counts per
set leave the task. Sets that are no part of the same component can't link.

Candidates are verified on the whole sets, which travel as compressed texts. Components are found by hooking every root
to its smallest neighbour and shortening the paths, until no link joins two of them. Nothing of unbounded size is
collected or broadcast: what has one row for each frequent shingle has ``frequent_limit`` rows at most, and keys that
hold more than a thousandth of a table's rows, of which there are a thousand at most, are split over many tasks.

Shingles and words are hashed by 64 bits. Sets are told apart by 64 bits, too, and the few that share these with
another set by another 64.

Defined results: a text without words, or null, has no shingles and is its own component; a text of fewer words than a
shingle has one shingle, all of it; repeated rows are one set and each get a row; documents without an id link
like others, but a null is no candidate for a component's smallest id, which is null where no document has one; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import parts, small_batches
from shelfmark.llm.hot import hot_keys, join_one
from shelfmark.llm.shared import emptied, stored
from shelfmark.llm.shingles import WORDS, mix, shingle_sets

PERCENT = 80
#: Shingles known as frequent at most, and the number of sets from which one can be.
FREQUENT_LIMIT, FREQUENT_FROM = 1_000_000, 16
#: Sets that a task remembers, so as not to count a copy again.
REMEMBERED = 200_000
#: Sets taken together when lists or counts are dealt out.
ROWS = 1000
#: Shingles that are counted, or listed, together.
GROUP_SHINGLES = 8_000_000
#: Bits by which shingles of a group are told apart while they are counted; the mark of a long step between two of them.
COUNTED_BITS, LONG_STEP = 25, 0xFFFF
#: Sets and shingles of a block of a component, on average at most, and entries of a block of a list.
BLOCK_SETS, BLOCK_SHINGLES, BLOCK_ENTRIES = 1000, 200_000, 2000
#: Shingles that are compared at once.
BLOCK_COLUMNS = 4096
#: Start value of a set's second hash (any would do).
SECOND = 0x5851F42D4C957F2D
#: Shingles that are dealt out together while they are counted.
DEALT = 700_000


class SetIds:
    """Numbers for sets: ``bits`` of a hash, or another 64 where two different sets are known to share it."""

    def __init__(self, bits: int = 64, twins: frozenset[int] = frozenset()):
        self.bits, self.twins = bits, twins

    def __call__(self, shingles: np.ndarray) -> int:
        x = mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)) >> np.uint64(64 - self.bits)
        a = int(x.view(np.int64)[0])
        return self.second(shingles) if a in self.twins else a

    def second(self, shingles: np.ndarray) -> int:
        x = mix(shingles ^ np.uint64(SECOND)).sum(dtype=np.uint64) ^ np.uint64(len(shingles))
        return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def groups_of(hashes: np.ndarray, n_groups: int) -> np.ndarray:
    """Group by the upper bits of a hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(n_groups) >> np.uint64(32)).astype(np.int64)


def list_key(hashes: np.ndarray, n_groups: int) -> np.ndarray:
    """A shingle's group and its lower 32 bits, the name of its list; two shingles may share one."""
    return groups_of(hashes, n_groups) << np.int64(32) | (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64)


def new_sets(
    batches: Iterator[pa.RecordBatch], words: int, ids: SetIds
) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Sets with their ids, some at a time, without most that the task had before."""
    seen: set[int] = set()
    for batch in parts(batches, ROWS):
        found = []
        for shingles in shingle_sets(batch.column("text").to_pylist(), words):
            if len(shingles) and (a := ids(shingles)) not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(a)
                found.append((a, shingles))
        if found:
            yield found


def split_by(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by group, the groups, and their bounds in it."""
    order = np.argsort(groups, kind="stable")
    found, starts = np.unique(groups[order], return_index=True)
    return order, found, np.append(starts, len(order))


def shown(hashes: np.ndarray) -> np.ndarray:
    """The bits by which shingles of a group are told apart while they are counted."""
    return (mix(hashes) >> np.uint64(64 - COUNTED_BITS)).astype(np.int64)


def steps(groups: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The groups in order, and each one's numbers sorted, as 16-bit steps from one to the next."""
    keys = np.sort(groups << COUNTED_BITS | numbers)
    groups, numbers = keys >> COUNTED_BITS, keys & ((1 << COUNTED_BITS) - 1)
    found, starts = np.unique(groups, return_index=True)
    step = np.diff(numbers, prepend=0)
    step[starts] = numbers[starts]
    long = step // LONG_STEP
    at = np.cumsum(long + 1) - 1
    out = np.full(int(at[-1]) + 1, LONG_STEP, "<u2")
    out[at] = step - long * LONG_STEP
    bounds = np.append(at[starts] - long[starts], len(out))
    return found, [out[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def numbers_of(packed: bytes) -> np.ndarray:
    """The numbers that ``steps`` has packed."""
    step = np.frombuffer(packed, "<u2").astype(np.int64)
    return np.cumsum(step)[step != LONG_STEP]


def grouped(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each value of g, of batches that are sorted by it."""
    last, held = None, []
    for batch in batches:
        for g, *row in zip(batch.column("g").to_pylist(), *(batch.column(name).to_pylist() for name in names)):
            if g != last and held:
                yield last, held
                held = []
            last = g
            held.append(tuple(row))
    if held:
        yield last, held


def frequencies(docs: DataFrame, words: int, n_groups: int, at_least: int, ids: SetIds) -> DataFrame:
    """h, n: the shingles of more than ``at_least`` sets, as their group and the bits shown.

    Shingles travel packed by group, as sorted steps of two bytes; that two of a group agree in the bits shown may
    place one of them too late in the order, alike for all sets.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for found in new_sets(batches, words, ids):
            held += [shingles for _, shingles in found]
            total += sum(len(shingles) for _, shingles in found)
            if total >= DEALT:
                yield dealt_out(held)
                held, total = [], 0
        if held:
            yield dealt_out(held)

    def dealt_out(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(held)
        groups, packed = steps(groups_of(hashes, n_groups), shown(hashes))
        return pa.RecordBatch.from_arrays([pa.array(groups), pa.array(packed, pa.binary())], names=["g", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, held in grouped(batches, ("packed",)):
            low, n = np.unique(np.concatenate([numbers_of(packed).astype(np.uint32) for (packed,) in held]), return_counts=True)
            low, n = low[n > at_least], n[n > at_least]
            key = np.int64(g) << np.int64(32) | low.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["h", "n"])

    dealt = docs.select("text").mapInArrow(deal, "g long, packed binary").repartition(n_groups, "g").sortWithinPartitions("g")
    return dealt.mapInArrow(count, "h long, n long")


class Order:
    """The global order: size class of a frequent shingle (0 for all others), then its hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n_groups: int):
        order = np.argsort(keys)
        self.keys, self.classes = keys[order], np.log2(np.maximum(counts[order], 1)).astype(np.int64) + 1
        self.n_groups = n_groups

    def classes_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64)
        keys = groups_of(hashes, self.n_groups) << 32 | shown(hashes)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.classes[at], 0)


def reaches(left, sizes, percent: int):
    """The length and positional filter: what is left of both sets, and their sizes together."""
    return (100 + percent) * left >= percent * sizes


def list_pairs(
    h: np.ndarray, a: np.ndarray, n: np.ndarray, i: np.ndarray, percent: int, limit: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets in the same list of up to ``limit`` sets, smaller id first; the rows of all longer lists.

    Entries of the same length and position are a block of their list; of two blocks that can't reach the overlap, no
    pair is made.
    """
    order = np.lexsort((a, i, n, h))
    first = np.ones(len(order), bool)
    first[1:] = (h[order[1:]] != h[order[:-1]]) | (a[order[1:]] != a[order[:-1]])
    order = order[first]
    _, starts, sizes = np.unique(h[order], return_index=True, return_counts=True)
    is_short = np.repeat(sizes <= limit, sizes)
    long, order = order[~is_short], order[is_short]
    h, a, n, i = h[order], a[order], n[order], i[order]
    edge = np.ones(len(h), bool)
    edge[1:] = (h[1:] != h[:-1]) | (n[1:] != n[:-1]) | (i[1:] != i[:-1])
    block = np.flatnonzero(edge)
    size = np.diff(np.append(block, len(h)))
    bh, bn, left = h[block], n[block], n[block] - i[block]
    xs, ys = [], []
    for step in range(len(block)):
        met = np.flatnonzero(bh[step:] == bh[: len(bh) - step])
        if not len(met):
            break
        met = met[reaches(np.minimum(left[met], left[met + step]), bn[met] + bn[met + step], percent)]
        many = size[met] * size[met + step]
        of = np.repeat(met, many)
        number = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        xs.append(a[block[of] + number // size[of + step]])
        ys.append(a[block[of + step] + number % size[of + step]])
    if not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), long
    x, y = np.concatenate(xs), np.concatenate(ys)
    pairs = np.stack([np.minimum(x, y), np.maximum(x, y)])[:, x != y]
    pairs = np.unique(pairs, axis=1)
    return pairs[0], pairs[1], long


def small(numbers: np.ndarray) -> np.ndarray:
    """Two bytes each where they fit, else four."""
    return numbers.astype("<u2" if not len(numbers) or numbers.max() < 1 << 16 else "<u4")


def index_lists(docs: DataFrame, order: Order, words: int, percent: int, set_ids: SetIds) -> DataFrame:
    """x, y: pairs from the lists of few sets; h, x, n, i (y null): entries of all others."""
    n_groups = order.n_groups

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in new_sets(batches, words, set_ids):
            ids = np.array([a for a, _ in found], np.int64)
            sizes = np.array([len(shingles) for _, shingles in found], np.int64)
            hashes = np.concatenate([shingles for _, shingles in found])
            owner = np.repeat(np.arange(len(found)), sizes)
            classes = order.classes_of(hashes)
            ranked = np.lexsort((hashes, classes, owner))
            hashes, classes = hashes[ranked], classes[ranked]
            place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = place <= sizes[owner] - -(-percent * sizes // 100)[owner]
            hashes, classes, place, owner = hashes[keep], classes[keep], place[keep], owner[keep]
            # Entries of frequent shingles are dealt by their set: a list may be of any size.
            frequent = classes > 0
            groups = np.where(frequent, ids[owner] % n_groups, groups_of(hashes, n_groups)) * 2 + frequent
            by, groups, bounds = split_by(groups)
            keys = list_key(hashes, n_groups)
            rows = []
            for g, s, e in zip(groups, bounds, bounds[1:]):
                at = by[s:e]
                own = keys[at].astype("<i8") if g % 2 else (keys[at] & 0xFFFFFFFF).astype("<u4")
                columns = own, ids[owner[at]].astype("<i8"), small(sizes[owner[at]]), small(place[at])
                rows.append((g // 2, g % 2 == 1, *(c.tobytes() for c in columns)))
            kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["g", "frequent", "h", "a", "n", "i"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h=None, x=None, y=None, n=None, i=None):
            size = len(x)
            full = lambda v: pa.array(v) if v is not None else pa.nulls(size, pa.int64())
            return pa.RecordBatch.from_arrays([full(v) for v in (h, x, y, n, i)], names=["h", "x", "y", "n", "i"])

        def numbers(packed: bytes, count: int) -> np.ndarray:
            return np.frombuffer(packed, "<u2" if len(packed) == 2 * count else "<u4").astype(np.int64)

        for g, rows in grouped(batches, ("frequent", "h", "a", "n", "i")):
            held = []
            for frequent, h, a, n, i in rows:
                x = np.frombuffer(a, "<i8")
                if frequent:
                    yield out(h=np.frombuffer(h, "<i8"), x=x, n=numbers(n, len(x)), i=numbers(i, len(x)))
                else:
                    held.append((np.frombuffer(h, "<u4"), x, numbers(n, len(x)), numbers(i, len(x))))
            if held:
                h, a, n, i = (np.concatenate(c) for c in zip(*held))
                x, y, long = list_pairs(h, a, n, i, percent, FREQUENT_FROM)
                yield out(x=x, y=y)
                yield out(h=np.int64(g) << np.int64(32) | h[long].astype(np.int64), x=a[long], n=n[long], i=i[long])

    packed = "g long, frequent boolean, h binary, a binary, n binary, i binary"
    dealt = docs.select("text").mapInArrow(deal, packed).repartition(n_groups, "g").sortWithinPartitions("g")
    return dealt.mapInArrow(read, "h long, x long, y long, n long, i long")


def compressed(docs: DataFrame) -> DataFrame:
    """The keys of ``docs`` and their text as zstd bytes z, for the way through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in parts(batches, ROWS):
            z = [pack.compress(t.encode()) if t is not None else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(z, pa.binary())], names=["key", "z"])

    return docs.mapInArrow(run, "key long, z binary")


def sets_of(packed: list[bytes], words: int) -> list[np.ndarray]:
    """The shingle sets of compressed texts."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return shingle_sets([unpack.decompress(z).decode() for z in packed], words)


def with_sets(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """``pairs`` (x, y) with their distance and whether they link, from the whole sets."""
    # Merge joins at any size: what is small here is so only in small corpora.
    of_x = join_one(pairs, texts.select(F.col("a").alias("x"), F.col("z").alias("zx")).hint("merge"), "x")
    both = of_x.join(texts.select(F.col("a").alias("y"), F.col("z").alias("zy")).hint("merge"), "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, ROWS):
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            held = dict(zip([*x, *y], [*batch.column("zx").to_pylist(), *batch.column("zy").to_pylist()]))
            sets = dict(zip(held, sets_of(list(held.values()), words)))
            nx, ny, common = [], [], []
            for s, t in ((sets[p], sets[q]) for p, q in zip(x, y)):
                both = np.sort(np.concatenate([s, t]), kind="stable")
                nx.append(len(s))
                ny.append(len(t))
                common.append(int((both[1:] == both[:-1]).sum()))
            numbers = [pa.array(v, pa.int64()) for v in (nx, ny, common)]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), *numbers], names=["x", "y", "nx", "ny", "common"])

    compared = both.select("x", "y", "zx", "zy").mapInArrow(compare, "x long, y long, nx long, ny long, common long")
    union = F.col("nx") + F.col("ny") - F.col("common")
    return compared.select("x", "y", (1 - F.col("common") / union).alias("distance"), (100 * F.col("common") >= percent * union).alias("links"))


def components(links: DataFrame) -> DataFrame | None:
    """a, root for every linked set, root the smallest set of its component; None without links."""
    edges = stored(links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct(), "edges")
    found = None
    while not edges.isEmpty():
        ends = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hooks = ends.groupBy(F.col("x").alias("a")).agg(F.min("y").alias("root"))
        hooks = stored(hooks.select("a", F.least("a", "root").alias("root")), "hooks")
        while True:  # until every path has one step
            above = hooks.select(F.col("a").alias("root"), F.col("root").alias("upper"))
            shorter = join_one(hooks, above, "root", "left").select("a", F.coalesce("upper", "root").alias("root"), (F.col("upper") < F.col("root")).alias("moved"))
            shorter = stored(shorter, "hooks")
            hooks = shorter.select("a", "root")
            if shorter.where("moved").isEmpty():
                break
        if found is None:
            found = hooks
        else:
            step = hooks.select(F.col("a").alias("root"), F.col("root").alias("upper"))
            found = stored(join_one(found, step, "root", "left").select("a", F.coalesce("upper", "root").alias("root")), "found")
        ends_at = lambda name: hooks.select(F.col("a").alias(name), F.col("root").alias(f"r{name}"))
        moved = join_one(join_one(edges, ends_at("x"), "x"), ends_at("y"), "y", hot=hot_keys(edges, "y"))
        edges = stored(moved.select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).where("x <> y").distinct(), "edges")
    return found


def rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with the root of their set ``x``, itself where it has no links."""
    if roots is None:
        return rows.withColumn("root", F.col("x"))
    named = roots.select(F.col("a").alias("x"), F.col("root").alias("r"))
    return rows.join(named, "x", "left").withColumn("root", F.coalesce("r", "x")).drop("r")


def linked_counts(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many sets of ``right`` each of ``left`` links with, and the reverse; without ``right``, of ``left`` itself."""
    sides = [left] if right is None else [left, right]
    sizes = [np.array([len(s) for s in side], np.int64) for side in sides]
    owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
    hashes = [np.concatenate(side) for side in sides]
    shared = np.intersect1d(np.unique(hashes[0]), np.unique(hashes[1])) if right is not None else np.unique(hashes[0])
    places = []
    for h, own in zip(hashes, owner):
        at = np.minimum(np.searchsorted(shared, h), max(0, len(shared) - 1))
        found = shared[at] == h if len(shared) else np.zeros(len(h), bool)
        at, own = at[found], own[found]
        order = np.argsort(at, kind="stable")
        places.append((at[order], own[order]))
    common = np.zeros((len(sizes[0]), len(sizes[-1])), np.float32)  # whole numbers below 2^24 are exact
    for start in range(0, len(shared), BLOCK_COLUMNS):
        width = min(BLOCK_COLUMNS, len(shared) - start)
        held = []
        for (at, own), n in zip(places, sizes):
            a, b = np.searchsorted(at, [start, start + width])
            m = np.zeros((len(n), width), np.float32)
            m[own[a:b], at[a:b] - start] = 1
            held.append(m)
        common += held[0] @ held[-1].T
    common = common.astype(np.int64)
    links = 100 * common >= percent * (sizes[0][:, None] + sizes[-1][None, :] - common)
    if right is None:
        np.fill_diagonal(links, False)
    return links.sum(axis=1), links.sum(axis=0)


def count_links(members: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """x, n_links of the sets of whole components: ``members`` has x, its root and its number of shingles n."""
    # Sets that link are of the same class of length or of neighbouring ones.
    length = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9) if percent < 100 else F.col("n")
    members = members.withColumn("c", length.cast("long"))
    needed = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int")
    blocks = members.groupBy("root", "c").agg(needed.alias("k"))
    by_root = blocks.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("c", "k"))).alias("ks"))
    placed = join_one(members, by_root, "root").withColumn("b", F.pmod(F.xxhash64("x"), F.element_at("ks", F.col("c"))).cast("int"))
    to = lambda c: F.sequence(F.lit(0), F.element_at("ks", c) - 1)
    c, b = F.col("c"), F.col("b")
    own = F.transform(to(c), lambda o: F.struct(c.alias("c1"), F.least(b, o).alias("b1"), c.alias("c2"), F.greatest(b, o).alias("b2"), (b > o).alias("is_right")))
    longer = F.transform(to(c + 1), lambda o: F.struct(c.alias("c1"), b.alias("b1"), (c + 1).alias("c2"), o.alias("b2"), F.lit(False).alias("is_right")))
    shorter = F.transform(to(c - 1), lambda o: F.struct((c - 1).alias("c1"), o.alias("b1"), c.alias("c2"), b.alias("b2"), F.lit(True).alias("is_right")))
    none = F.array().cast("array<struct<c1:bigint,b1:int,c2:bigint,b2:int,is_right:boolean>>")
    met = F.concat(own, *(F.when(F.map_contains_key("ks", o), side).otherwise(none) for o, side in ((c + 1, longer), (c - 1, shorter))))
    dealt = placed.select("root", "x", F.explode(met).alias("m")).select("root", "m.*", "x")
    packed = dealt.join(texts.select(F.col("a").alias("x"), "z").hint("merge"), "x")
    key = ["root", "c1", "b1", "c2", "b2"]
    sorted_ = packed.repartition(*key).sortWithinPartitions(*key).select(*key, "is_right", "x", "z")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(meets: tuple, sides: tuple[dict, dict]) -> Iterator[pa.RecordBatch]:
            left, right = (sets_of(list(side.values()), words) for side in sides)
            same = meets[1:3] == meets[3:5]
            if left and (same or right):
                n, m = linked_counts(left, None if same else right, percent)
                ids, counts = (list(sides[0]), n) if same else ([*sides[0], *sides[1]], np.concatenate([n, m]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["x", "n_links"])

        meets, sides = None, ({}, {})
        for batch in parts(batches, ROWS):
            columns = [batch.column(name).to_pylist() for name in (*key, "is_right", "x", "z")]
            for *at, is_right, x, z in zip(*columns):
                if meets != tuple(at):
                    if meets is not None:
                        yield from close(meets, sides)
                    meets, sides = tuple(at), ({}, {})
                sides[is_right][x] = z
        if meets is not None:
            yield from close(meets, sides)

    return sorted_.mapInArrow(count, "x long, n_links long").groupBy("x").agg(F.sum("n_links").alias("n_links"))


def near(percent: int, a: str, b: str) -> Column:
    """The length and positional filter between two entries of a list."""
    left = F.least(F.col(f"n{a}") - F.col(f"i{a}"), F.col(f"n{b}") - F.col(f"i{b}"))
    return reaches(left, F.col(f"n{a}") + F.col(f"n{b}"), percent)


def described(docs: DataFrame, words: int, set_ids: SetIds) -> DataFrame:
    """doc_id, key, the size of its set, the set's id and second id (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, ROWS):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            numbers = [(len(s), set_ids(s), set_ids.second(s)) if len(s) else (0, None, None) for s in sets]
            columns = [pa.array(c, pa.int64()) for c in zip(*numbers)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], names=["doc_id", "key", "n_shingles", "a", "second"])

    return stored(docs.mapInArrow(run, "doc_id long, key long, n_shingles long, a long, second long"), "sets")


def texts_of(docs: DataFrame, chosen: DataFrame, hot: list[int], words: int, set_ids: SetIds) -> DataFrame:
    """a, z: the compressed text of each set of ``chosen`` (a, key); a set may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat an id
        for batch in parts(batches, ROWS):
            sets, same = sets_of(batch.column("z").to_pylist(), words), []
            for i, (s, a) in enumerate(zip(sets, batch.column("a").to_pylist())):
                if a not in seen and len(s) and set_ids(s) == a:
                    seen.add(a)
                    same.append(i)
            yield batch.select(["a", "z"]).take(pa.array(same, pa.int64()))

    joined = join_one(compressed(docs).where("z is not null"), chosen.hint("merge"), "key", hot=hot)
    return stored(joined.select("a", "z").mapInArrow(run, "a long, z binary"), "texts")


def similar_sets(
    docs: DataFrame, percent: int = PERCENT, words: int = WORDS, frequent_limit: int = FREQUENT_LIMIT, id_bits: int = 64
) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (how many different sets the document's set links with)."""
    spark = docs.sparkSession
    small_batches(spark)
    # Texts are looked up by key: the id, or without one a hash of the text. Two texts of a key are told apart by their sets.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), "text")
    base = described(docs, words, SetIds(id_bits))
    twins = base.groupBy("a").agg(F.min("second").alias("s"), F.max("second").alias("t")).where("s <> t").select("a").collect()
    set_ids = SetIds(id_bits, frozenset(row.a for row in twins))  # a few in 10**10
    if twins:
        base = described(docs, words, set_ids)
    shingles = base.agg(F.sum("n_shingles")).first()[0] or 0
    n_groups = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // GROUP_SHINGLES))

    counted = stored(frequencies(docs, words, n_groups, FREQUENT_FROM, set_ids), "frequent")
    classes = counted.groupBy(F.floor(F.log2("n")).alias("c")).count().collect()  # 63 at most
    bar, held = FREQUENT_FROM, 0
    for row in sorted(classes, reverse=True):
        held += row["count"]
        if held > frequent_limit:
            bar = max(bar, 2 ** (row.c + 1) - 1)
            break
    known = counted.where(F.col("n") > bar).toPandas()
    order = Order(known.h.to_numpy(np.int64), known.n.to_numpy(np.int64), n_groups)
    lists = stored(index_lists(docs, order, words, percent, set_ids), "lists")
    pairs = lists.where("y is not null").select("x", "y").distinct()

    def of_lists(rows: DataFrame, one: DataFrame) -> DataFrame:
        """``rows`` with what ``one`` says of their list; if the bar wasn't raised, that are as many rows as known shingles."""
        return rows.join(F.broadcast(one), "h") if bar == FREQUENT_FROM else join_one(rows, one, "h")

    # Longer lists; of lists with the same sets, the first in the order holds every pair's first shared shingle.
    entries = lists.where("y is null").groupBy("h", "x").agg(F.min("n").alias("n"), F.min("i").alias("i"))
    about = entries.groupBy("h").agg(
        F.min("x").alias("p"), F.count("*").alias("size"), F.sum("i").alias("at"), F.min("n").alias("least"),
        F.bit_xor(F.xxhash64("x")).alias("f1"), F.bit_xor(F.xxhash64("x", F.lit(1))).alias("f2"),
    ).where("size > 1")
    chosen = about.groupBy("size", "f1", "f2").agg(F.min_by(F.struct("h", "p", "least"), F.struct("at", "h")).alias("l")).select("l.*")
    # Entries too late in their set for the shortest set of the list are skipped.
    early = reaches(F.col("n") - F.col("i"), F.col("n") + F.col("least"), percent)
    rows = stored(of_lists(entries, chosen).where(early).select("h", "x", "n", "i"), "entries")
    # The set with the fewest rarer shingles is the one that copies of a text differ from least.
    pivots = rows.groupBy("h").agg(F.min_by(F.struct("x", "n", "i"), F.struct("i", "x")).alias("p"))
    pivots = stored(pivots.select("h", F.col("p.x").alias("p"), F.col("p.n").alias("np"), F.col("p.i").alias("ip")), "pivots")
    listed = rows.select("h", "x", F.col("n").alias("nx"), F.col("i").alias("ix"))
    stars = of_lists(listed, pivots).where((F.col("x") != F.col("p")) & near(percent, "x", "p"))
    stars = stars.select(F.col("p").alias("x"), F.col("x").alias("y")).distinct()
    first = stored(pairs.unionByName(stars).distinct(), "pairs")

    # The texts of all sets that may be compared.
    asked = first.select(F.col("x").alias("a")).unionByName(first.select(F.col("y").alias("a"))).unionByName(rows.select(F.col("x").alias("a"))).distinct()
    every = base.where("a is not null").groupBy("a")
    owners = stored(every.agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("n_shingles").alias("n")), "owners")
    repeated = hot_keys(base, "key")
    texts = texts_of(docs, stored(asked.join(owners.select("a", "key"), "a"), "asked"), repeated, words, set_ids)
    told = stored(with_sets(first, texts, percent, words).dropDuplicates(["x", "y"]), "told")
    links = told.where("links").select("x", "y")

    # What the pivots leave open in the longer lists.
    roots = components(links)
    marked = rooted(rows, roots)
    span = marked.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low < high")
    parted = stored(span.join(pivots, "h").select("h", "p", F.ceil(F.col("size") / BLOCK_ENTRIES).cast("int").alias("k")), "parted")
    if not parted.isEmpty():
        to_pivot = told.select(F.col("x").alias("p"), F.col("y").alias("x"), "distance")
        open_rows = stored(of_lists(marked, parted).join(to_pivot, ["p", "x"], "left"), "open")
        sizes = open_rows.groupBy("h", "root").count()
        largest = stored(sizes.groupBy("h").agg(F.max_by("root", F.struct("count", "root")).alias("main")), "main")
        side = lambda s: open_rows.select("h", "k", *(F.col(c).alias(f"{c}{s}") for c in ("x", "n", "i", "root", "distance", "p")))
        # Both sides of a long list are dealt into blocks, and each block of one meets each of the other.
        block, every = (lambda c: F.pmod(F.xxhash64(c), F.col("k")).cast("int")), F.explode(F.sequence(F.lit(0), F.col("k") - 1))
        others = of_lists(side("1"), largest).where("root1 <> main").withColumn("b1", block("x1")).withColumn("b2", every)
        all_rows = side("2").withColumn("b2", block("x2")).withColumn("b1", every).drop("k")
        crossed = others.join(all_rows, ["h", "b1", "b2"]).where(
            (F.col("root1") != F.col("root2"))
            & ((F.col("root2") == F.col("main")) | (F.col("x1") < F.col("x2")))
            & (F.col("x1") != F.col("p1")) & (F.col("x2") != F.col("p1"))
            & near(percent, "1", "2")
            & (F.coalesce(F.abs(F.col("distance1") - F.col("distance2")), F.lit(0.0)) <= 1 - percent / 100 + 1e-9)
        )
        rest = crossed.select(F.least("x1", "x2").alias("x"), F.greatest("x1", "x2").alias("y")).distinct()
        rest = stored(rest.join(first.select("x", "y"), ["x", "y"], "left_anti"), "rest")
        more = stored(with_sets(rest, texts, percent, words), "more").where("links").select("x", "y")
        if not more.isEmpty():
            links = links.unionByName(more).distinct()
            roots = components(links)

    of_sets = rooted(owners.select(F.col("a").alias("x"), "doc_id", "n"), roots)
    smallest = of_sets.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    links = links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    ends = links.select("x").unionByName(links.select(F.col("y").alias("x")))
    degree = ends.groupBy("x").agg(F.count("*").alias("n_links"))
    if roots is not None:
        # Only components with frequent shingles can have links that were not compared, and only if some pair is not known.
        linked = rooted(degree, roots).join(owners.select(F.col("a").alias("x"), "n"), "x")
        frequent = rows.select("x").distinct().withColumn("is_frequent", F.lit(True))
        linked = stored(linked.join(frequent, "x", "left"), "linked")
        known = linked.groupBy("root").agg(F.count("*").alias("size"), F.sum("n_links").alias("ends"), F.max("is_frequent").alias("is_frequent"))
        open_roots = known.where(F.col("is_frequent") & (F.col("ends") < F.col("size") * (F.col("size") - 1))).select("root", F.lit(True).alias("open"))
        linked = stored(join_one(linked, open_roots, "root", "left"), "linked")
        counted_links = count_links(linked.where("open").select("x", "root", "n"), texts, percent, words)
        degree = counted_links.unionByName(linked.where("open is null").select("x", "n_links"))
    of_sets = stored(of_sets, "of_sets")
    by_set = join_one(of_sets, smallest, "root").join(degree, "x", "left").select(F.col("x").alias("a"), "component_id", "n_links")
    by_set = stored(by_set, "by_set")
    for step in (lists, texts, first, told):
        emptied(step)
    result = join_one(base.where("a is not null").select("doc_id", "n_shingles", "a"), by_set, "a", "left")
    empty = base.where("a is null").select("doc_id", "n_shingles", "a", F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("n_links"))
    return result.unionByName(empty).select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )

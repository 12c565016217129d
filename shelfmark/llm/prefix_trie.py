"""A prefix trie of conversations, built as z-fast tries.

A conversation is a sequence of turns (role, text); a node is a distinct sequence of first turns. Turns are 128-bit
digests, and so are prefixes (each digests the one before with the next turn); equal ones are taken for the same.

A z-fast trie is compacted: an edge spans the turns up to the next branch or end. A table maps the handle of each
compacted node, the prefix whose length is the two-fattest number (the one with the most trailing zero bits) in the edge's
range, to the node. The exit node of a conversation is found by fat binary search: two-fattest lengths are looked up, so
that log2(turns) look-ups do. Conversations come in batches: all of a batch find their exits first, then those are
split or given a new leaf, each insertion going on from the exit it found. At last the edges are expanded into a node for
each length.

How this is dealt out. Equal conversations are made one, with their number, smallest id and the digest of their ids, which
are gathered over ranges of ids and so come in order. A prefix with more than ``group`` different conversations is hot,
and these are dealt out by longer prefixes, so that each group fits a task, however many share their first turns. Nodes
below the dealing prefix are whole in one task; of those above, the tasks give parts, which are added by key.

Defined results: rows without a conv_id are left out; turns go by turn (null first), role, then digest; null roles and
texts are empty; rows that repeat are turns of their own; a conversation is taken as a unit (28 bytes for each of its
turns in a task); remainders of negative ids are not negative, as in Python; an empty table gives no nodes; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import parts
from shelfmark.llm.hot import join_one
from shelfmark.llm.shared import stored

#: A family's conversations borrow up to HEADS - 1 first turns from its first one.
FAMILY, HEADS = 5, 9
#: Bytes of a digest, and the digest of no turns.
WIDTH, ROOT = 16, bytes(16)
EMPTY = hashlib.sha256(b"").hexdigest()
#: Conversations of a hot prefix: more than a thousandth of all, within these limits.
GROUP_LEAST, GROUP_MOST = 200, 20_000
#: Conversations that find their exits at a time, and conversations and bytes in a trie after which the next group begins a new one.
BATCH, HELD, HELD_BYTES = 1024, 20_000, 64 << 20
NODE_SCHEMA = (
    "key binary, parent binary, path binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
    " saved_tokens long, own_bytes long, ends_sha256 string, crown boolean"
)
NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] with the most trailing zero bits."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Sequence:
    """A distinct conversation: prefix digests by length (that of no turns first), bytes of each turn's text, copies, smallest id,
    digest of the ids, and how it is dealt: by its first ``split`` turns, below a node whose smallest id is ``up``."""

    __slots__ = ("keys", "size", "texts", "copies", "conv", "ends", "split", "up")

    def __init__(self, keys: bytes, texts: bytes, copies: int, conv: int, ends: str, split: int = 1, up: int | None = None):
        self.keys, self.size = ROOT + keys, len(keys) // WIDTH
        self.texts, self.copies, self.conv, self.ends, self.split, self.up = np.frombuffer(texts, np.int64), copies, conv, ends, split, up

    def key(self, depth: int) -> bytes:
        return self.keys[depth * WIDTH : (depth + 1) * WIDTH]


class Node:
    """A compacted node: its extent is the first ``depth`` turns of ``of``, its edge begins behind ``above`` turns."""

    __slots__ = ("of", "above", "depth", "parent", "children", "end", "n", "conv", "leaves", "saved")

    def __init__(self, of: Sequence | None, above: int, depth: int):
        self.of, self.above, self.depth, self.parent = of, above, depth, None
        self.children: dict[bytes, Node] = {}
        self.end: Sequence | None = None

    def handle(self) -> bytes:
        return self.of.key(two_fattest(self.above, self.depth))


class ZFastTrie:
    def __init__(self):
        self.root = Node(None, -1, 0)
        self.handles: dict[bytes, Node] = {}

    def exit(self, seq: Sequence, start: Node | None = None) -> Node:
        """The deepest node, at or below ``start``, whose extent begins the sequence: fat binary search."""
        node = start or self.root
        low, high = node.depth, seq.size
        while low < high:
            f = two_fattest(low, high)
            hit = self.handles.get(seq.key(f))
            if hit is None:
                high = f - 1
            elif hit.depth <= seq.size and hit.of.key(hit.depth) == seq.key(hit.depth):
                node, low = hit, hit.depth
            else:  # the sequence leaves the trie on the edge of this node
                return hit.parent
        return node

    def insert(self, seq: Sequence, start: Node | None = None) -> None:
        node = self.exit(seq, start)
        if node.depth < seq.size:
            edge = node.children.get(seq.key(node.depth + 1))
            node = self._link(node, Node(seq, node.depth, seq.size)) if edge is None else self._split(node, edge, seq)
        node.end = seq

    def _link(self, parent: Node, node: Node) -> Node:
        node.parent = parent
        parent.children[node.of.key(parent.depth + 1)] = node
        self.handles[node.handle()] = node
        return node

    def _split(self, parent: Node, edge: Node, seq: Sequence) -> Node:
        """Cuts an edge where the sequence leaves it; gives the node at the end of the sequence."""
        low, high = parent.depth + 1, min(edge.depth, seq.size)
        while low < high:  # the digests agree just as far as the sequences do
            middle = (low + high + 1) // 2
            low, high = (middle, high) if edge.of.key(middle) == seq.key(middle) else (low, middle - 1)
        del self.handles[edge.handle()]
        cut = self._link(parent, Node(edge.of, parent.depth, low))
        edge.above = low
        self._link(cut, edge)
        return cut if low == seq.size else self._link(cut, Node(seq, low, seq.size))

    def insert_batch(self, batch: list[Sequence]) -> None:
        # Edges are only cut, so the exits that are found first stay on the paths, and each search goes on from there.
        exits = [self.exit(seq) for seq in batch]
        for seq, start in zip(batch, exits):
            self.insert(seq, start)

    def nodes(self) -> list[Node]:
        """All compacted nodes, parents first."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children.values())
        return order


def expanded(trie: ZFastTrie) -> Iterator[tuple]:
    """Rows of NODE_SCHEMA, one for each length on each edge.

    Those above the dealing prefixes (crown) are parts: their children, leaves and saved bytes are only what is whole here.
    """
    order = trie.nodes()
    for node in reversed(order):
        below = node.children.values()
        node.n = sum(c.n for c in below) + (node.end.copies if node.end else 0)
        node.conv = min([c.conv for c in below] + ([node.end.conv] if node.end else []), default=None)
    for node in reversed(order):
        below = node.children.values()
        split = node.of.split if node.of else 1
        leaves = sum(c.leaves for c in below) if below or node.depth < split else 1
        saved = sum(c.saved for c in below)
        # Children that are whole here; all of them are if the node is.
        children = sum(c.above + 1 >= c.of.split for c in below)
        for depth in range(node.depth, node.above, -1):
            size, whole, up = int(node.of.texts[depth - 1]) if depth else 0, depth >= split, None
            if whole:
                saved += (node.n - 1) * size
                up = node.of.up if depth == split else node.conv if depth > node.above + 1 else node.parent.conv
            yield (
                node.of.key(depth) if depth else ROOT, node.of.key(depth - 1) if depth else None,
                None if whole or not depth else node.of.keys[: depth * WIDTH], depth, node.conv, up, node.n, children, leaves, saved, size,
                node.end.ends if node.end and depth == node.depth else None, not whole,
            )
            children = int(whole)  # of the length before
        node.leaves, node.saved = leaves, saved


_ARROW = pa.schema([
    ("key", pa.binary()), ("parent", pa.binary()), ("path", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("own_bytes", pa.int64()),
    ("ends_sha256", pa.string()), ("crown", pa.bool_()),
])


def _batches(rows: Iterator[tuple], size: int = 5000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)


def rebuilt_conversations(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Each conversation with first turns of its family's first one: conv_id, key, keys, sizes, stored.

    A conversation c takes the first h turns of c - c % family, h = crc32(c) % heads, then its own after its first h.
    """
    conv = F.col("conv_id").cast("long")
    div = F.lit(family).cast("long")
    of = F.when(conv >= 0, F.expr(f"conv_id div {family}")).otherwise(-F.expr(f"(-(conv_id + 1)) div {family}") - 1)
    text = lambda c: F.encode(F.coalesce(F.col(c).cast("string"), F.lit("")), "UTF-8")
    framed = F.concat(F.encode(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":")), "UTF-8"), text("role"), text("text"))
    turns = conversations.select(conv.alias("conv_id"), "turn", "role", "text").where("conv_id is not null").select(
        of.alias("family"), "conv_id", (F.pmod("conv_id", div) == 0).alias("first"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"),
        F.substring(F.unhex(F.sha2(framed, 256)), 1, WIDTH).alias("digest"), F.octet_length(text("text")).cast("long").alias("size"),
    )
    dealt = turns.repartition("family").sortWithinPartitions("family", "conv_id", F.col("turn").asc_nulls_first(), "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("key", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary())])
        out, held = [], 0
        now, head = None, (None, [], [])
        digests, sizes = [], []

        def made() -> dict:
            h = zlib.crc32(str(now[1]).encode()) % heads
            if now[2]:
                own, lengths = digests, sizes
            else:
                first = head if head[0] == now[0] else (None, [], [])
                own, lengths = first[1][:h] + digests[h:], first[2][:h] + sizes[h:]
            key, keys = ROOT, []
            for digest in own:
                key = hashlib.blake2b(key + digest, digest_size=WIDTH).digest()
                keys.append(key)
            return {"conv_id": now[1], "key": key, "keys": b"".join(keys), "sizes": np.array(lengths, np.int64).tobytes()}

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("family", "conv_id", "first", "digest", "size")]
            for of, conv, first, digest, size in zip(*columns):
                if now is None or now[1] != conv:
                    if now:
                        out.append(made())
                        held += len(out[-1]["keys"]) + 100
                        if now[2]:
                            head = (now[0], digests[:heads], sizes[:heads])
                    now, digests, sizes = (of, conv, first), [], []
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, held = [], 0
                digests.append(digest)
                sizes.append(size)
        if now:
            out.append(made())
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    lean = dealt.select("family", "conv_id", "first", "digest", "size")
    return stored(lean.mapInArrow(run, "conv_id long, key binary, keys binary, sizes binary"), "rebuilt")


def distinct_sequences(rebuilt: DataFrame) -> DataFrame:
    """Equal conversations made one: key, conv_id (smallest), copies, ends (digest of the ids in order), keys, sizes, stored."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal keys within a range of ids; ids ascend."""
        schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("copies", pa.int64()), ("ids", pa.string()), ("keys", pa.binary()), ("sizes", pa.binary())])
        now, ids = None, []
        row = lambda: {"key": now["key"], "first": ids[0], "copies": len(ids), "ids": ",".join(map(str, ids)), "keys": now["keys"], "sizes": now["sizes"]}
        for batch in parts(batches):
            out = []
            for r in batch.to_pylist():
                if now is None or now["key"] != r["key"]:
                    if now:
                        out.append(row())
                    now, ids = r, []
                ids.append(r["conv_id"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of a key follow each other in the order of their ids, so their digest goes on from run to run."""
        schema = pa.schema([("key", pa.binary()), ("conv_id", pa.int64()), ("copies", pa.int64()), ("ends", pa.string()), ("keys", pa.binary()), ("sizes", pa.binary())])
        now, digest, copies = None, None, 0
        row = lambda: {"key": now["key"], "conv_id": now["first"], "copies": copies, "ends": digest.hexdigest(), "keys": now["keys"], "sizes": now["sizes"]}
        for batch in parts(batches):
            out = []
            for r in batch.to_pylist():
                if now is None or now["key"] != r["key"]:
                    if now:
                        out.append(row())
                    now, digest, copies = r, hashlib.sha256(r["ids"].encode()), r["copies"]
                else:
                    digest.update(b"," + r["ids"].encode())
                    copies += r["copies"]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    ranges = rebuilt.repartitionByRange("conv_id").sortWithinPartitions("key", "conv_id")
    runs = ranges.mapInArrow(gathered, "key binary, first long, copies long, ids string, keys binary, sizes binary")
    merged = runs.repartition("key").sortWithinPartitions("key", "first")
    return stored(merged.mapInArrow(digested, "key binary, conv_id long, copies long, ends string, keys binary, sizes binary"), "sequences")


def dealt_sequences(sequences: DataFrame, group: int | None = None) -> DataFrame:
    """With the length ``split`` of the prefix by which each is dealt out, the shortest that isn't hot, and the smallest id of
    the node above (``up``)."""
    total = sequences.agg(F.count("*").alias("n"), F.min("conv_id").alias("up")).first()
    group = group or min(max(GROUP_LEAST, total.n // 1000), GROUP_MOST)
    prefix = lambda d: F.substring(F.col("keys"), (d - 1) * WIDTH + 1, F.lit(WIDTH))
    rows = sequences.withColumn("prefix", prefix(F.lit(1))).where("length(keys) > 0")
    hot = rows.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > group).select("prefix")
    hot = stored(hot, "hot-turns")
    plain = {"split": F.lit(1), "up": F.lit(total.up)}
    if hot.isEmpty():
        return sequences.withColumns(plain)
    under = join_one(rows, hot, "prefix").select("key", "conv_id", "keys")
    length = F.expr(f"cast(length(keys) div {WIDTH} as int)")
    each = under.select("key", "conv_id", F.explode(F.transform(F.sequence(F.lit(1), length), lambda d: F.struct(d.alias("d"), prefix(d).alias("prefix")))).alias("x"))
    each = stored(each.select("key", "conv_id", "x.d", "x.prefix"), "hot-prefixes")
    crowded = stored(each.groupBy("prefix").agg(F.count("*").alias("n"), F.min("conv_id").alias("up")).where(F.col("n") > group).select("prefix", "up"), "crowded")
    deepest = join_one(each, crowded, "prefix").groupBy("key").agg(F.max_by(F.struct("d", "up"), "d").alias("x"))
    found = sequences.join(deepest, "key", "left")
    return found.select(*sequences.columns, (F.coalesce("x.d", F.lit(0)) + 1).alias("split"), F.coalesce("x.up", F.lit(total.up)).alias("up"))


def trie_nodes(dealt: DataFrame) -> DataFrame:
    """Nodes of z-fast tries over the dealt sequences (NODE_SCHEMA), stored; those of the crown are parts."""
    length = F.expr(f"cast(length(keys) div {WIDTH} as int)")
    at = F.least(F.col("split"), length)
    grouped = dealt.withColumn("group", F.when(at > 0, F.substring(F.col("keys"), (at - 1) * WIDTH + 1, F.lit(WIDTH))).otherwise(F.lit(bytearray(ROOT))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, waiting, held, size, now = ZFastTrie(), [], 0, 0, None
        for batch in parts(batches):
            for r in batch.to_pylist():
                if r["group"] != now and (held >= HELD or size >= HELD_BYTES):
                    trie.insert_batch(waiting)
                    yield from _batches(expanded(trie))
                    trie, waiting, held, size = ZFastTrie(), [], 0, 0
                now = r["group"]
                waiting.append(Sequence(r["keys"], r["sizes"], r["copies"], r["conv_id"], r["ends"], r["split"], r["up"]))
                held += 1
                size += len(r["keys"]) * 2
                if len(waiting) >= BATCH:
                    trie.insert_batch(waiting)
                    waiting = []
        if held:
            trie.insert_batch(waiting)
            yield from _batches(expanded(trie))

    return stored(grouped.repartition("group").sortWithinPartitions("group", "key").mapInArrow(run, NODE_SCHEMA), "nodes")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, group: int | None = None) -> DataFrame:
    """One row for each node of the prefix trie of the rebuilt conversations (see the module): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. ``group``: most different conversations of a prefix
    that one task gets (None: by their number)."""
    sequences = distinct_sequences(rebuilt_conversations(conversations, family, heads))
    nodes = trie_nodes(dealt_sequences(sequences, group))
    whole = nodes.where("not crown").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).select(*NODE_COLUMNS)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    crown = nodes.where("crown").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("path").alias("path"), *sums,
        F.max("own_bytes").alias("own_bytes"), F.max("ends_sha256").alias("ends_sha256"),
    )
    crown = stored(crown, "crown")
    own = (F.col("n_convs") - 1) * F.col("own_bytes")
    # What each of the crown saves counts for all above it, too; their digests are its path.
    ups = F.transform(F.sequence(F.lit(0), F.col("depth").cast("int") - 1), lambda d: F.substring(F.col("path"), d * WIDTH + 1, F.lit(WIDTH)))
    saved = crown.where("depth > 0").select(own.alias("more"), F.explode(ups).alias("key")).groupBy("key").agg(F.sum("more").alias("more"))
    inner = crown.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("inner"))
    above = crown.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = crown.join(saved, "key", "left").join(inner, "key", "left").join(above, "parent", "left")
    children = F.col("n_children") + F.coalesce("inner", F.lit(0))
    top = full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", children.alias("n_children"), F.when(children == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + own + F.coalesce("more", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    return whole.unionByName(top)

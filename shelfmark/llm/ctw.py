"""Scoring of texts by context-tree weighting over bytes, beside a word-count base.

A byte is eight binary decisions along the path of its bits. For each of the 255 places on such paths there is a
context tree over the bytes before: its nodes hold how often a zero and a one followed that context in training, for
contexts of 0 to ``depth`` bytes. A node's weighted probability is half its Krichevsky-Trofimov estimate and half the
product of its children's; the share of the first half in the sum is the weight with which the node predicts by its
own counts instead of by a longer context. The tree is built from all training documents and then frozen. A text's
score is the log10 probability of its bytes and an end mark (byte 255, which no UTF-8 text holds), with zero bytes
before its start.

Documents are dealt into batches of about ``batch_bytes`` of text by a hash; of ids that hold a great share of the
rows, equal rows are counted first. A batch asks for what it needs: its distinct words and its distinct runs of depth +
1 bytes, with their counts in training. Word counts are summed by a hash of the word, runs by a partial and a full sum.
Contexts of two bytes and more are weighted where all runs with the same last two context bytes are, some groups of
these at a time, and of a large group a part with whole contexts of three bytes at a time; contexts of one byte and
none, 256 * 255 + 255 nodes, are combined from these. Every batch gets the answers to what it asked, and scores its
documents with these. So no table of words or contexts is broadcast, and what a task holds is bounded by a batch, by
the codes and counts (16 bytes each) of the different runs with the same two bytes, or by the nodes of those with the
same three.

Defined results: a null text is an empty one, whose only token is the end; without training documents every byte has
probability 2**-8; words of any length count; repeated rows are scored each, and count in training each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import small_batches
from shelfmark.llm.hot import hot_keys
from shelfmark.llm.sampling import id_remainder
from shelfmark.llm.shared import stored

DEPTH = 5
START, END = b"\0" * DEPTH, b"\xff"
BATCH_BYTES = 24 << 20
#: Bytes whose runs are counted or looked up at a time, and runs that are weighted at a time (about 1 KB each).
STEP_BYTES, STEP_RUNS = 1 << 18, 1 << 17
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The end token among words.
END_TOKEN = b""
HALF = np.log(0.5)


def lowered(text: str | None) -> bytes:
    return text.encode().translate(LOWER) if text else b""


def tokens(data: bytes) -> list[bytes]:
    return [*data.split(), END_TOKEN]


def runs(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of depth + 1 bytes ending at each byte or end mark of the texts, and where each text starts in them."""
    data = np.frombuffer(b"".join([b"\0" * depth + text + END for text in texts]), np.uint8).astype(np.int64)
    code = data[depth:].copy()
    for back in range(1, depth + 1):
        code |= data[depth - back : -back] << np.int64(8 * back)
    sizes = np.array([len(text) + 1 for text in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keep = np.ones(len(code), bool)
    for k in range(depth):  # the places of the next text's start bytes
        keep[(starts[1:] + depth * np.arange(len(texts) - 1)) + k] = False
    return code[keep], starts


def portions(texts: Sequence[bytes], numbers: Sequence[int], size: int = STEP_BYTES) -> Iterator[list[int]]:
    """The numbers of texts in portions of about ``size`` bytes."""
    held, total = [], 0
    for i in numbers:
        held.append(i)
        total += len(texts[i])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with the sums of their counts."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.add.reduceat(counts[order], starts)


def count_runs(texts: Sequence[bytes], copies: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of texts that stand for so many copies each (none: only asked for), and their counts."""
    codes, counts, pending = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for number in sorted(set(copies)):
        for portion in portions(texts, [i for i, n in enumerate(copies) if n == number]):
            found, n = np.unique(runs([texts[i] for i in portion], depth)[0], return_counts=True)
            codes.append(found)
            counts.append(n * number)
            pending += len(found)
            if pending > max(STEP_RUNS, len(codes[0]) // 2):
                merged = summed(np.concatenate(codes), np.concatenate(counts))
                codes, counts, pending = [merged[0]], [merged[1]], 0
    return summed(np.concatenate(codes), np.concatenate(counts))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers, best in order, as compressed bytes of their steps."""
    import zstandard

    step = np.diff(numbers, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(step.T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(rows.T).view("<i8").ravel())


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0 (Stirling's series at x + 8)."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def weigh(kt: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(HALF + kt, HALF + below)


class Level:
    """The nodes of contexts of ``depth`` bytes (code of the context * 256 + place on the bits' path)."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int):
        self.depth, self.bits = depth, np.stack([(codes >> (7 - j) & 1).astype(np.uint8) for j in range(8)])
        self.keys, at = np.unique(self.nodes(codes), return_inverse=True)
        self.at = at.astype(np.int32).reshape(8, -1)
        # A place on the path at a time: counts are whole numbers, so their sums are exact in any order.
        n = sum(np.bincount(at * 2 + bits, counts, 2 * len(self.keys)) for at, bits in zip(self.at, self.bits)).reshape(-1, 2)
        self.n0, self.n1 = n[:, 0], n[:, 1]
        self.kt = log_kt(self.n0, self.n1)
        self.weighted = self.kt
        self.one = (self.n1 + 0.5) / (self.n0 + self.n1 + 1)

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The nodes on the paths of the runs' last bytes, a row for each bit."""
        context = (codes >> 8) & ((1 << 8 * self.depth) - 1)
        x = codes & 255
        return np.stack([context * 256 + ((1 << j) | (x >> (8 - j))) for j in range(8)])

    def sums(self, child: Level) -> np.ndarray:
        """The sums of the next longer contexts' weighted logs at their nodes."""
        node = (child.keys >> 8 & ((1 << 8 * self.depth) - 1)) * 256 + (child.keys & 255)
        return np.bincount(np.searchsorted(self.keys, node), child.weighted, len(self.keys))

    def take(self, below: np.ndarray) -> None:
        """Weighs the nodes with the sums of those of the next longer contexts."""
        self.weighted = weigh(self.kt, below)

    def own_share(self) -> np.ndarray:
        return np.exp(HALF + self.kt - self.weighted)


def levels(codes: np.ndarray, counts: np.ndarray, depth: int, least: int = 2) -> list[Level]:
    """Levels of ``depth`` down to ``least`` of all runs that share their last ``least`` context bytes."""
    found = [Level(codes, counts, d) for d in range(depth, least - 1, -1)]
    for i, level in enumerate(found[1:]):
        level.take(level.sums(found[i]))
    return found


def pieces(codes: np.ndarray, depth: int) -> list[np.ndarray | slice]:
    """Places of the runs in parts that are weighted at a time; where there are several, none cuts a context of three bytes."""
    if len(codes) <= 2 * STEP_RUNS or depth < 3:
        return [slice(None)]
    three = codes >> 8 & 0xFFFFFF
    order = np.argsort(three, kind="stable")
    starts = np.flatnonzero(np.diff(three[order], prepend=-1))
    firsts = starts[np.flatnonzero(np.diff(starts // STEP_RUNS, prepend=-1))]
    return np.split(order, firsts[1:])


def level_two(codes: np.ndarray, counts: np.ndarray, depth: int) -> Level:
    """The level of two bytes of all runs that share them, weighted."""
    parts = pieces(codes, depth)
    if len(parts) == 1:
        return levels(codes, counts, depth)[-1]
    level = Level(*summed(codes & 0xFFFFFF, counts), 2)
    level.take(sum(level.sums(levels(codes[part], counts[part], depth, 3)[-1]) for part in parts))
    return level


class Top:
    """Estimates and own shares of the nodes of one byte of context (a row each) and of none, by place."""

    def __init__(self, last: np.ndarray, place: np.ndarray, weighted: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        sums = lambda at, values, shape: np.bincount(at, values, int(np.prod(shape))).reshape(shape)
        counts = [sums(last * 256 + place, n, (256, 256)) for n in (n0, n1)]
        kt = log_kt(*counts)
        above = weigh(kt, sums(last * 256 + place, weighted, (256, 256)))
        self.one, self.share = (counts[1] + 0.5) / (counts[0] + counts[1] + 1), np.exp(HALF + kt - above)
        counts = [n.sum(axis=0) for n in counts]
        kt = log_kt(*counts)
        self.root_one = (counts[1] + 0.5) / (counts[0] + counts[1] + 1)
        self.root_share = np.exp(HALF + kt - weigh(kt, above.sum(axis=0)))


def log10_predictions(codes: np.ndarray, counts: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """log10 of the mixed probability of each run's last byte after the bytes before it."""
    parts = pieces(codes, depth)
    if len(parts) == 1:
        return _predictions(codes, levels(codes, counts, depth), top)
    two = level_two(codes, counts, depth)
    logs = np.empty(len(codes))
    for part in parts:
        logs[part] = _predictions(codes[part], levels(codes[part], counts[part], depth, 3), top, two)
    return logs


def _predictions(codes: np.ndarray, found: list[Level], top: Top, two: Level | None = None) -> np.ndarray:
    """The logs of runs by the levels made from these, and by ``two``, made from more runs, if that isn't among them."""
    one = found[0].one[found[0].at]
    for level in found[1:]:
        share = level.own_share()[level.at]
        one = share * level.one[level.at] + (1 - share) * one
    if two is not None:
        at = np.searchsorted(two.keys, two.nodes(codes))
        share = two.own_share()[at]
        one = share * two.one[at] + (1 - share) * one
    x, last = codes & 255, codes >> 8 & 255
    place = np.stack([(1 << j) | (x >> (8 - j)) for j in range(8)])
    share = top.share[last, place]
    one = share * top.one[last, place] + (1 - share) * one
    share = top.root_share[place]
    one = share * top.root_one[place] + (1 - share) * one
    return np.log10(np.where(found[0].bits == 1, one, 1 - one)).sum(axis=0)


class Texts(Sequence):
    """The texts of a column, lower-cased each time they are read, so that no second copy of all of them is held."""

    def __init__(self, column: pa.ChunkedArray):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, i: int) -> bytes:
        return lowered(self.column[i].as_py())

    def __iter__(self) -> Iterator[bytes]:
        return (lowered(text.as_py()) for text in self.column)


class Batch:
    """The documents of a batch."""

    def __init__(self, table: pa.Table):
        self.texts = Texts(table.column("text"))
        self.learn, self.copies = table.column("learn").to_pylist(), table.column("copies").to_pylist()


def _ask(batch: Batch, n_groups: int, depth: int) -> list[tuple]:
    """What a batch needs: per group of words, the words and their training counts; runs and theirs."""
    codes, counts = count_runs(batch.texts, [n if learn else 0 for n, learn in zip(batch.copies, batch.learn)], depth)
    asked = (None, packed(codes), packed(counts))
    del codes, counts
    words: Counter[bytes] = Counter()
    for text, learn, n in zip(batch.texts, batch.learn, batch.copies):
        if learn:
            words.update(tokens(text) if n == 1 else {w: n * k for w, k in Counter(tokens(text)).items()})
    for text, learn in zip(batch.texts, batch.learn):
        if not learn:
            words.update(dict.fromkeys([w for w in set(tokens(text)) if w not in words], 0))
    dealt: dict[int, list[bytes]] = {}
    for word in words:
        dealt.setdefault(zlib.crc32(word) % n_groups, []).append(word)
    rows = [(p, b"\n".join(own), np.array([words[w] for w in own], "<i8").tobytes()) for p, own in dealt.items()]
    return [*rows, asked]


def counted_once(docs: DataFrame) -> DataFrame:
    """``docs`` with copies, their number; equal rows of ids with a great share of the rows are one row."""
    keyed = docs.withColumn("key", F.xxhash64("doc_id"))
    hot = hot_keys(keyed, "key")
    if not hot:
        return docs.withColumn("copies", F.lit(1).cast("long"))
    is_hot = F.col("key").isin(hot)
    equal = keyed.where(is_hot).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    return keyed.where(~is_hot).select("doc_id", "text", F.lit(1).cast("long").alias("copies")).unionByName(equal)


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2, batch_bytes: int = BATCH_BYTES, depth: int = DEPTH) -> DataFrame:
    """One row per document with both scores; ids with crc32 remainder ``held`` are not learned from.

    ``depth`` is the longest context in bytes, 2 to 6.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = counted_once(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    marked = own.withColumn("learn", id_remainder(F.col("doc_id"), modulus) != held)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches = int(size // batch_bytes) + 1
    dealt = marked.withColumn("b", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches))).repartition(n_batches, "b")

    def ask(key, table):
        rows = _ask(Batch(table), n_batches, depth)
        kinds = {"p": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
        columns = {name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), zip(*rows))}
        return pa.table({"b": pa.array([key[0].as_py()] * len(rows), pa.int64()), **columns})

    asked = stored(dealt.groupBy("b").applyInArrow(ask, "b long, p long, keys binary, counts binary"), "asked")

    def answer_words(table):
        total: Counter[bytes] = Counter()
        kept = [k.as_py().split(b"\n") for k in table.column("keys")]
        for words, counts in zip(kept, table.column("counts")):
            for word, n in zip(words, np.frombuffer(counts.as_py(), "<i8").tolist()):
                total[word] += n
        found = [np.array([total[w] for w in words], "<i8").tobytes() for words in kept]
        # The group's distinct and all training tokens are told once.
        news = [sum(n > 0 for n in total.values())] + [0] * (len(kept) - 1)
        trained = [sum(total.values())] + [0] * (len(kept) - 1)
        answers = {"b": table.column("b"), "keys": table.column("keys"), "counts": pa.array(found, pa.binary())}
        return pa.table({**answers, "n_new": pa.array(news, pa.int64()), "n_train": pa.array(trained, pa.int64())})

    word_schema = "b long, keys binary, counts binary, n_new long, n_train long"
    words = stored(asked.where("p is not null").groupBy("p").applyInArrow(answer_words, word_schema), "words")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, keys, counts in zip(batch.column("b"), batch.column("keys"), batch.column("counts")):
                codes, n = unpacked(keys.as_py()), unpacked(counts.as_py())
                for start in range(0, len(codes), STEP_RUNS):
                    part = slice(start, start + STEP_RUNS)
                    own = np.full(len(codes[part]), b.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(codes[part]), pa.array(n[part])], names=["b", "code", "n"])

    wanted = asked.where("p is null").mapInArrow(spread, "b long, code long, n long")
    sums = stored(wanted.groupBy("code").agg(F.sum("n").alias("n")), "runs")
    together = sums.withColumn("two", F.expr("code >> 8 & 65535")).repartition("two").sortWithinPartitions("two")

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes and counts of some groups at a time, no group cut."""
        held: list[np.ndarray] = []
        n, last, cut = 0, -1, 0  # runs held, the last one's group, and where that starts
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column("code").to_numpy(), batch.column("n").to_numpy()]))
            two = held[-1][0] >> 8 & 65535
            starts = np.flatnonzero(np.diff(two, prepend=last))
            if len(starts):
                cut, last = n + int(starts[-1]), two[-1]
            n += len(two)
            if n >= STEP_RUNS and cut:
                rows = np.concatenate(held, axis=1)
                held, n = [rows[:, cut:].copy()], n - cut
                yield rows[0, :cut], rows[1, :cut].astype(float)
                cut = 0
        if n:
            rows = np.concatenate(held, axis=1)
            yield rows[0], rows[1].astype(float)

    def weigh_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, counts in whole_groups(batches):
            level = level_two(codes, counts, depth)
            node, at = np.unique((level.keys >> 8 & 255) * 256 + (level.keys & 255), return_inverse=True)
            columns = [node, *(np.bincount(at, v, len(node)) for v in (level.weighted, level.n0, level.n1))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "w", "n0", "n1"])

    at_last = together.mapInArrow(weigh_all, "node long, w double, n0 double, n1 double").groupBy("node")
    rows = sorted(at_last.agg(F.sum("w"), F.sum("n0"), F.sum("n1")).collect())  # 255 places for each of 256 bytes at most
    by_node = np.array(rows, float).reshape(-1, 4)
    node = by_node[:, 0].astype(np.int64)
    top = Top(node >> 8, node & 255, *by_node.T[1:])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, counts in whole_groups(batches):
            logs = log10_predictions(codes, counts, depth, top).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(logs)], names=["code", "log10p"])

    predicted = together.mapInArrow(predict, "code long, log10p float")
    run_answers = wanted.select("b", "code").join(predicted, "code")
    answers = words.select("b", "keys", "counts", F.lit(None).cast("long").alias("code"), F.lit(None).cast("float").alias("log10p")).unionByName(
        run_answers.select("b", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"), "code", "log10p")
    )

    def score(docs_table, answer):
        batch = Batch(docs_table)
        texts = batch.texts
        is_word = pc.is_null(answer.column("code"))
        own = answer.select(["code", "log10p"]).filter(pc.invert(is_word))
        codes, logs = own.column("code").to_numpy(), own.column("log10p").to_numpy()
        del own
        order = np.argsort(codes)
        codes, logs = codes[order], logs[order]
        del order
        scores = np.zeros(len(texts))
        for portion in portions(texts, range(len(texts))):
            every, starts = runs([texts[i] for i in portion], depth)
            found, at = np.unique(every, return_inverse=True)
            scores[portion] = np.add.reduceat(logs[np.searchsorted(codes, found)].astype(np.float64)[at], starts)
        del codes, logs
        # Words come after the runs are done with, so that a task doesn't hold both.
        count: dict[bytes, int] = {}
        of_words = answer.select(["keys", "counts"]).filter(is_word)
        for keys, counts in zip(of_words.column("keys"), of_words.column("counts")):
            count.update(zip(keys.as_py().split(b"\n"), np.frombuffer(counts.as_py(), "<i8").tolist()))
        n_tokens, n_known, known_log = [], [], []
        for text in texts:
            c = np.array(list(map(count.__getitem__, tokens(text))), np.float64)
            n_tokens.append(len(c))
            n_known.append(int((c > 0).sum()))
            known_log.append(float(np.log10(c + 1).sum()))
        return pa.table({
            "doc_id": docs_table.column("doc_id"), "copies": docs_table.column("copies"), "held_out": pa.array([not x for x in batch.learn]),
            "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "known_log": pa.array(known_log, pa.float64()), "score": pa.array(scores),
        })

    result_schema = "doc_id long, copies long, held_out boolean, n_tokens long, n_known long, known_log double, score double"
    scored = dealt.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(score, result_schema)
    told = words.agg(F.sum("n_new"), F.sum("n_train")).first()
    v, n = told[0] or 0, told[1] or 0
    base = F.col("known_log") - F.col("n_tokens") * float(np.log10(n + v + 1))
    each = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )

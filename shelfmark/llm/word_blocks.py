"""Texts as blocks of word codes: tokenised once, with a vocabulary of the words that are frequent in their language.

Words are hashed with their language by 63 bits (two of 10^7 different words share these with a chance of one in 10^5). A block holds half a million words or so: numbers into its own list of distinct words, 0 for the end of a piece. The
lists, not the words, are dealt out by hash; who holds a part of the hashes counts them, keeps those with enough
occurrences, numbers them, and answers each block with the numbers of its words. So neither the vocabulary nor any other
table that grows with the corpus is broadcast.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import light_batches, parts, small_batches
from shelfmark.llm.shared import stored
from shelfmark.llm.shingles import LOWER, SEED, _byte_values, _powers, mix

#: Kinds of bytes: of a word, between words, between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
#: Words in a block, bytes hashed at a time, and distinct words of blocks that a task counts at a time.
BLOCK_WORDS, CHUNK, PART_WORDS = 1 << 19, 1 << 20, 1 << 20
#: Entries of a block that the next one repeats where a text goes on, so that phrases across the cut start once.
OVERLAP = 3
BLOCK_SCHEMA = (
    "block string, entries binary, tail int, hashes binary, counts binary, words binary, langs array<string>, word_lang binary, lang_words array<long>"
)


def packed(values: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def cuts(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of about CHUNK bytes that end behind a byte that is of no word, or at the end."""
    start = 0
    while len(text) - start > CHUNK:
        window = KIND[np.frombuffer(text, np.uint8, CHUNK, start)]
        ends = np.flatnonzero(window)
        at = start + CHUNK
        if len(ends):
            at = start + int(ends[-1]) + 1
        else:  # a very long word: to its end
            while at < len(text) and not len(more := np.flatnonzero(KIND[np.frombuffer(text, np.uint8, min(CHUNK, len(text) - at), at)])):
                at = min(len(text), at + CHUNK)
            at = len(text) if at >= len(text) else at + int(more[0]) + 1
        yield text[start:at]
        start = at
    yield text[start:]


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; a longer span than CHUNK is added up part by part."""
    if len(data) <= 2 * CHUNK:
        power, inverse = _powers(2 * CHUNK)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_byte_values()[data] * power[: len(data)], dtype=np.uint64)])
        return (sums[ends] - sums[starts]) * inverse[starts]
    found = np.zeros(len(starts), np.uint64)
    power = _powers(2 * CHUNK)[0]
    for i, (start, end) in enumerate(zip(starts, ends)):
        far = np.ones(1, np.uint64)  # arrays wrap around without a warning
        for at in range(start, end, CHUNK):
            part = data[at : min(end, at + CHUNK)]
            found[i : i + 1] += (_byte_values()[part] * power[: len(part)]).sum(dtype=np.uint64, keepdims=True) * far
            far = far * power[CHUNK : CHUNK + 1]
    return found


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of ``data``, and whether a new piece begins with each."""
    kind = KIND[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], kind == 0, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    hashes = mix(_sums(data, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(SEED))
    breaks = np.concatenate([[0], np.cumsum(kind == 2)])[starts]
    return starts, ends, hashes, np.diff(breaks, prepend=0) > 0


class _Block:
    """Words gathered for a block."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.data, self.size, self.hashes, self.spans, self.lang = [], 0, [], [], []
        self.count, self.langs = 0, {}

    def add(self, text: bytes, lang: str, fresh: bool) -> None:
        """Words of (part of) a text; ``fresh``: a text begins here."""
        data = np.frombuffer(text, np.uint8)
        starts, ends, hashes, new = word_hashes(data)
        if not len(starts):
            # Only separators; they may end a piece, which an entry 0 says.
            if fresh or (KIND[data] == 2).any():
                self.put(np.zeros(1, np.uint64), np.full((1, 2), self.size), [lang])
            return
        if fresh:
            new[0] = True
        hashes = mix(hashes ^ lang_salt(lang)) | np.uint64(1)
        # An entry 0 before each word that begins a piece, and one behind the last word if its piece ends here.
        at = np.arange(len(starts)) + np.cumsum(new)
        ended = bool((KIND[data[ends[-1] :]] == 2).any())
        entries = np.zeros(at[-1] + 1 + ended, np.uint64)
        spans = np.full((len(entries), 2), self.size)
        entries[at] = hashes
        spans[at, 0], spans[at, 1] = starts + self.size, ends + self.size
        self.data.append(text)
        self.size += len(text)
        self.put(entries, spans, [lang])

    def put(self, entries: np.ndarray, spans: np.ndarray, langs: list[str]) -> None:
        """``langs``: one for all entries, or one for each."""
        self.hashes.append(entries)
        self.spans.append(spans)
        numbers = np.array([self.langs.setdefault(lang, len(self.langs)) for lang in langs], np.int32)
        self.lang.append(numbers if len(langs) > 1 else np.full(len(entries), numbers[0]))
        self.count += len(entries)

    def row(self, number: str, going_on: bool) -> dict:
        hashes, spans, lang = np.concatenate(self.hashes), np.concatenate(self.spans), np.concatenate(self.lang)
        tail = min(OVERLAP, len(hashes)) if going_on else 0
        known, first, inside = np.unique(hashes, return_index=True, return_inverse=True)
        shift = int(len(known) > 0 and known[0] == 0)  # 0 stands for the end of a piece
        counts = np.bincount(inside[: len(hashes) - tail], minlength=len(known))[shift:]
        own = hashes[: len(hashes) - tail] > 0
        lang_words = np.bincount(lang[: len(hashes) - tail][own], minlength=len(self.langs))
        data, first = b"".join(self.data), first[shift:]
        words = b" ".join([data[a:b] for a, b in spans[first].tolist()])
        row = {
            "block": number, "entries": packed(inside + 1 - shift, np.int32), "tail": tail, "hashes": packed(known[shift:], np.uint64),
            "counts": packed(counts, np.int64), "words": words, "langs": list(self.langs), "word_lang": packed(lang[first], np.int32),
            "lang_words": lang_words.tolist(),
        }
        named = [*self.langs]
        kept = (hashes[len(hashes) - tail :], spans[len(hashes) - tail :], [named[i] for i in lang[len(hashes) - tail :].tolist()]) if tail else None
        self.clear()
        if kept:
            rest = b" ".join([data[a:b] for a, b in kept[1].tolist()])
            sizes = kept[1][:, 1] - kept[1][:, 0]
            starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
            self.data, self.size = [rest + b" "], len(rest) + 1
            self.put(kept[0], np.stack([starts, starts + sizes], 1), kept[2])
        return row


@functools.lru_cache(maxsize=1000)
def lang_salt(lang: str) -> np.uint64:
    """A hash of a language's name."""
    data = np.frombuffer(lang.encode(), np.uint8)
    return mix(_sums(data, np.array([0]), np.array([len(data)])) + np.uint64(len(data)))[0]


def text_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of the lower-cased words of all texts, stored (see the module)."""
    small_batches(docs.sparkSession)
    light_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        block, schema = _Block(), None
        fields = pa.schema([
            ("block", pa.string()), ("entries", pa.binary()), ("tail", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()),
            ("langs", pa.list_(pa.string())), ("word_lang", pa.binary()), ("lang_words", pa.list_(pa.int64())),
        ])
        made = lambda going_on: pa.RecordBatch.from_pylist([block.row(uuid.uuid4().hex, going_on)], schema=fields)
        for batch in parts(batches):
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                text = (text.as_py() or "").encode().translate(LOWER)
                for number, part in enumerate(cuts(text)):
                    if block.count >= BLOCK_WORDS:
                        yield made(number > 0)
                    block.add(part, lang, number == 0)
        if block.count:
            yield made(False)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return stored(docs.select("text", lang).mapInArrow(run, BLOCK_SCHEMA), "blocks")


def language_sizes(blocks: DataFrame) -> DataFrame:
    """lang, n: occurrences of words."""
    each = blocks.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x")).select("x.langs", "x.lang_words")
    return each.groupBy(F.col("langs").alias("lang")).agg(F.sum("lang_words").alias("n")).where("n > 0")


def power_of_two(least: float, most: int) -> int:
    return min(most, 1 << max(0, int(np.ceil(np.log2(max(1.0, least))))))


def coded_blocks(blocks: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The vocabulary (code int, lang, word, n) of words with ``least`` occurrences in their language, and the blocks
    (codes binary int32, tail), with 0 for all other words and at the ends of pieces. Codes are dense from 1."""
    total = blocks.agg(F.sum(F.length("hashes") / 8)).first()[0] or 0
    n_parts = max(32, power_of_two(total / PART_WORDS, 1 << 16))
    shift = np.uint64(64 - n_parts.bit_length() + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            for row in batch.to_pylist():
                hashes, counts = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], np.int64)
                lang, words = np.frombuffer(row["word_lang"], np.int32), row["words"].split(b" ")
                edges = np.searchsorted(hashes >> shift, np.arange(n_parts + 1, dtype=np.uint64))
                rows = [
                    {"part": p, "block": row["block"], "hashes": packed(hashes[a:b], np.uint64), "counts": packed(counts[a:b], np.int64),
                     "words": b" ".join(words[a:b]), "langs": row["langs"], "word_lang": packed(lang[a:b], np.int32)}
                    for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a
                ]
                yield from pa.Table.from_pylist(rows, schema=dealt).to_batches()

    dealt = pa.schema([
        ("part", pa.int32()), ("block", pa.string()), ("hashes", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()),
        ("langs", pa.list_(pa.string())), ("word_lang", pa.binary()),
    ])
    told = pa.schema([
        ("part", pa.int32()), ("block", pa.string()), ("codes", pa.binary()), ("number", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()),
    ])

    def count(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
        known, inside = np.unique(every, return_inverse=True)
        n = np.zeros(len(known), np.int64)
        np.add.at(n, inside, np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]))
        number = np.where(n >= least, np.cumsum(n >= least), 0)
        wanted, at, out = set(np.flatnonzero(number).tolist()), 0, []
        for r in rows:
            size = len(r["hashes"]) // 8
            own = inside[at : at + size]
            at += size
            out.append({"part": r["part"], "block": r["block"], "codes": packed(number[own], np.int32)})
            if fresh := wanted.intersection(own[number[own] > 0].tolist()):
                words, lang = r["words"].split(b" "), np.frombuffer(r["word_lang"], np.int32)
                for i in np.flatnonzero(number[own]).tolist():
                    if (j := int(own[i])) in fresh:
                        out.append({
                            "part": r["part"], "number": int(number[j]), "lang": r["langs"][int(lang[i])], "word": words[i].decode(), "n": int(n[j]),
                        })
                wanted -= fresh
        yield from pa.Table.from_pylist(out, schema=told).to_batches(max_chunksize=1000)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in parts(batches, 16):
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield from count(held)
                    held = []
                held.append(row)
        if held:
            yield from count(held)

    schema = "part int, block string, hashes binary, counts binary, words binary, langs array<string>, word_lang binary"
    lists = blocks.select("block", "hashes", "counts", "words", "langs", "word_lang").mapInArrow(deal, schema)
    answers = stored(
        lists.repartition(n_parts, "part").sortWithinPartitions("part", "block")
        .mapInArrow(gather, "part int, block string, codes binary, number int, lang string, word string, n long"), "words",
    )
    found = answers.where("number is not null")
    sizes = {r.part: r["count"] for r in found.groupBy("part").count().collect()}  # a number for each part
    starts = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(n_parts)])])
    start = F.get(F.array(*[F.lit(int(x)) for x in starts]), F.col("part")) if n_parts <= 256 else None
    if start is None:
        table = blocks.sparkSession.createDataFrame([(p, int(x)) for p, x in enumerate(starts[:-1])], "part int, start int")
        found = found.join(table, "part").withColumn("code", F.col("start") + F.col("number"))
    else:
        found = found.withColumn("code", start + F.col("number"))
    vocabulary = found.select(F.col("code").cast("int").alias("code"), "lang", "word", "n")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            for row in batch.to_pylist():
                codes = [np.zeros(1, np.int32)]
                for answer in sorted(row["answers"], key=lambda a: a["part"]):
                    own = np.frombuffer(answer["codes"], np.int32)
                    codes.append(np.where(own > 0, own + np.int32(starts[answer["part"]]), 0).astype(np.int32))
                entries = np.concatenate(codes)[np.frombuffer(row["entries"], np.int32)]
                yield pa.RecordBatch.from_pydict({"codes": [packed(entries, np.int32)], "tail": pa.array([row["tail"]], pa.int32())})

    by_block = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("part", "codes")).alias("answers"))
    coded = blocks.select("block", "entries", "tail").join(by_block, "block").select("entries", "tail", "answers")
    return vocabulary, stored(coded.mapInArrow(encode, "codes binary, tail int"), "coded")

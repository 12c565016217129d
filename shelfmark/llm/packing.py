"""Packing of tokenised documents into fixed windows, best fit decreasing.

A document's ids (with an end id) are cut into full windows while more than a window is left; what remains is shorter
than a window and waits for best-fit decreasing: longest first, each piece goes into the open window with the least
room that still holds it. A segment tree over the remaining capacities 0..window finds that window in O(log window).

Each task packs the documents of its own partition in blocks of ``block`` remainders, so nothing is shuffled, memory
is bounded by the block, and a lost task is repeated with the same ids: a sequence's id is made of the partition's
number and a running number. What best fit leaves underfilled at the end of a block is cut into pieces of a power of
two, which need no padding.

Defined results: a null or empty text is the end id alone; documents of any length are cut, never dropped; repeated
rows are packed again, each with its own pieces; an empty table gives no sequences; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import parts, small_batches

WINDOW = 1024
#: Remainders packed together.
BLOCK = 50_000
#: A window with more padding than this, left at the end of a block, is cut into powers of two.
TAIL_ROOM = 64

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
ID_BYTES = 4


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree that answers "the least capacity of at least n"."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [False] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.size
        while node and not self.tree[node]:
            self.tree[node] = True
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the tightest window with room for ``need``, which is no longer open then."""
        node = need + self.size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not self.tree[2 * node])
        room = node - self.size
        window = self.windows[room].pop()
        if not self.windows[room]:
            self.tree[node] = False
            node >>= 1
            while node and not (self.tree[2 * node] or self.tree[2 * node + 1]):
                self.tree[node] = False
                node >>= 1
        return room, window


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows as lists of indices into ``lengths``, each of at most ``window`` in sum; ties keep their order."""
    opened, windows = OpenWindows(window), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if (found := opened.take(lengths[i])) is None:
            found = (window, len(windows))
            windows.append([])
        windows[found[1]].append(i)
        if found[0] > lengths[i]:
            opened.add(found[0] - lengths[i], found[1])
    return windows


def powers_of_two(total: int) -> list[int]:
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


#: A text with other white space than single spaces and line ends between words isn't cut into units.
PAIRED = ("  ", "\n ", " \n", "\n\n")
OTHER_SPACE = re.compile("[\x00\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The pieces of byte-level BPE (a fixed value of the format).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters on whose kind all libraries agree end here.
LAST_LETTER = "\u024f"
#: Units that a process remembers, and the longest of them.
KEPT_UNITS, LONGEST_UNIT = 400_000, 48


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merges_by_id(path: str) -> dict[bytes, int] | None:
    """Ids by token of a plain byte-level BPE file whose merges are ranked as their ids, else None."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, before = said["model"], said.get("pre_tokenizer") or {}
    plain = not (said.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    if not plain or model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if ids != sorted(set(ids)):
        return None
    byte = byte_letters()
    special = {t["content"] for t in said.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    singles = [ranks.get(bytes([b]), -1) for b in range(256)]
    return ranks if min(singles) >= 0 and max(singles) < min(ids, default=1 << 31) else None


class CachedTokenizer:
    """Ids of the ``tokenizers`` library as little-endian bytes, with a bounded cache of words.

    Byte-level BPE starts a new piece at a single space or line end that follows other text, so a text's words can be
    looked up one by one. Where the merges of the file are ranked by id, the new words of a text go through tiktoken's
    merge loop together, a line each, which gives the same ids in a quarter of the time. All else goes through
    ``tokenizers`` whole, as do texts that hold an added token of the file, which the library gives as one id.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.merge = None
        if ranks := merges_by_id(path):
            import tiktoken

            coding = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.merge, self.line_end = coding.encode_ordinary, ranks[b"\n"]
            self.always = {"": b"", "\n": array("I", [self.line_end]).tobytes()}

    def encode(self, text: str) -> bytes:
        if self.merge is None or any(pair in text for pair in PAIRED) or OTHER_SPACE.search(text):
            return self.whole(text)
        if text.endswith(" ") or any(token in text for token in self.added):  # a space before a line end is another word
            return self.whole(text)
        units = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        if len(self.known) > KEPT_UNITS or not self.known:
            self.known = dict(self.always)
        found = list(map(self.known.get, units))
        if None in found:
            new = list(dict.fromkeys([unit for unit, ids in zip(units, found) if ids is None]))
            if max(map(max, new)) > LAST_LETTER:
                return self.whole(text)
            learned = dict(zip(new, self._lines(new)))
            found = [learned[unit] if ids is None else ids for unit, ids in zip(units, found)]
            self.known.update((unit, ids) for unit, ids in learned.items() if len(unit) <= LONGEST_UNIT)
        return b"".join(found)

    def _lines(self, units: list[str]) -> list[bytes]:
        ids = np.array(self.merge("\n".join(units)), np.dtype("<u4"))
        ends = [*(np.flatnonzero(ids == self.line_end) * ID_BYTES).tolist(), len(ids) * ID_BYTES]
        coded = ids.tobytes()
        return [coded[a:b] for a, b in zip([0, *(end + ID_BYTES for end in ends)], ends)]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""


@functools.lru_cache(maxsize=1)
def cached_tokenizer(path: str) -> CachedTokenizer:
    """The tokenizer of a file, once per process; its cache serves all tasks of the process."""
    return CachedTokenizer(path)


class Packer:
    """Pieces of documents, packed block by block."""

    def __init__(self, first_sequence: int, window: int, block: int):
        self.sequence, self.window, self.block = first_sequence, window, block
        self.waiting: list[tuple[int | None, int, bytes, int]] = []
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, start, step = len(ids) // ID_BYTES, 0, self.window * ID_BYTES
        while total - start >= self.window:
            piece = ids[start * ID_BYTES : start * ID_BYTES + step]
            self.rows.append((doc_id, start, self.window, zlib.crc32(piece), total, self.sequence, 0))
            self.sequence += 1
            start += self.window
        if start < total:
            self.waiting.append((doc_id, start, ids[start * ID_BYTES :], total))
            if len(self.waiting) >= self.block:
                self.pack()

    def pack(self) -> None:
        lengths = [len(piece[2]) // ID_BYTES for piece in self.waiting]
        for members in best_fit_decreasing(lengths, self.window):
            filled = sum(lengths[i] for i in members)
            if self.window - filled <= TAIL_ROOM:
                sizes = [filled]
            else:
                sizes = powers_of_two(filled)
            self._place([self.waiting[i] for i in members], sizes)
        self.waiting.clear()

    def _place(self, pieces: list[tuple], sizes: list[int]) -> None:
        """Pieces one after the other into sequences of the given sizes, cut where a sequence is full."""
        sizes, offset = sizes[::-1], 0
        for doc_id, start, ids, total in pieces:
            at, length = 0, len(ids) // ID_BYTES
            while at < length:
                n = min(length - at, sizes[-1] - offset)
                code = zlib.crc32(ids[at * ID_BYTES : (at + n) * ID_BYTES])
                self.rows.append((doc_id, start + at, n, code, total, self.sequence, offset))
                at, offset = at + n, offset + n
                if offset == sizes[-1]:
                    sizes.pop()
                    offset = 0
                    self.sequence += 1

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 7
        names = [field.split()[0] for field in PIECE_SCHEMA.split(", ")]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    end = end_id.to_bytes(ID_BYTES, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = cached_tokenizer(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 40, window, block)
        for batch in parts(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                packer.add(doc_id, (tokenizer.encode(text) if text else b"") + end)
                if len(packer.rows) >= 20_000:
                    yield packer.drain()
        packer.pack()
        yield packer.drain()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE_SCHEMA)

"""Byte-level BPE encoding and decoding with the tiktoken library.

Every executor process builds one ``tiktoken.Encoding`` from a local rank file and keeps it for all its tasks. Texts
arrive as Arrow batches, so a task holds one batch at a time and nothing is shuffled.

tiktoken splits a text by a pattern and merges the bytes of each match separately. A text longer than ``CHUNK``
characters is cut before it reaches the library, only where the pattern always starts a new match: before ASCII white
space that follows a character which is no white space. The ids are those of the whole text.

Defined results: a null text is an empty one; an empty text has no ids; strings that look like special tokens are
ordinary text; ids decode to the exact UTF-8 bytes of the text; rows that repeat are encoded again and all returned;
other columns of the input are kept as they are, unless they carry the name of a result column, which then wins.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import ddl, parts, quoted, small_batches

#: Characters that reach the library in one call.
CHUNK = 1 << 16
#: A run that the pattern can't split safely is split by hand beyond this length.
LONG_RUN = 1 << 19
SAFE_CUT = re.compile(r"(?<=\S)(?=[\t-\r ])")


@functools.lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str):
    """The encoding of a rank file, once per process."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Pieces of ``text`` of about ``size`` characters, cut at safe places only; a piece without one stays whole."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, ranks_path: str, pattern: str) -> list[int]:
    """Ids of a whole text."""
    bpe = encoding(ranks_path, pattern)
    if not text:
        return []
    if len(text) <= CHUNK:
        return bpe.encode_ordinary(text)
    ids: list[int] = []
    for piece in chunks(text):
        if len(piece) <= LONG_RUN:
            ids += bpe.encode_ordinary(piece)
        else:
            for match in _splitter(pattern).finditer(piece):
                ids += bpe._encode_single_piece(match.group().encode())
    return ids


def decode(ids: list[int], ranks_path: str, pattern: str) -> bytes:
    """The raw bytes of ids, which need not be whole UTF-8 characters."""
    return encoding(ranks_path, pattern).decode_bytes(ids)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids"
) -> DataFrame:
    """``docs`` with a column of token ids, ``array<int>``."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 200):
            ids = [encode(t.as_py(), ranks_path, pattern) for t in batch.column(text_col)]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))], names=[*kept, ids_col])

    return docs.select(quoted(kept)).mapInArrow(run, f"{ddl(docs, kept)}, `{ids_col}` array<int>")


def decode_documents(
    encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded"
) -> DataFrame:
    """``encoded`` with the raw bytes of its ids instead of the ids; null ids give empty bytes."""
    small_batches(encoded.sparkSession)
    kept = [c for c in encoded.columns if c not in (ids_col, bytes_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 200):
            data = [decode(ids.as_py() or [], ranks_path, pattern) for ids in batch.column(ids_col)]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())], names=[*kept, bytes_col])

    schema = ", ".join(filter(None, [ddl(encoded, kept), f"`{bytes_col}` binary"]))
    return encoded.select(quoted([*kept, ids_col])).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes and decodes in one pass over each Arrow batch, so the ids of a batch never leave the process.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(ranks_path, pattern)
        words = [str(i) for i in range(bpe.n_vocab)]
        for batch in batches:
            counts, id_digests, byte_digests = [], [], []
            for text in batch.column("text"):
                ids = encode(text.as_py(), ranks_path, pattern)
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(" ".join([words[i] for i in ids]).encode()).hexdigest())
                byte_digests.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(byte_digests)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)

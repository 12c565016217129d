"""A deterministic sharded writer of WARC archives, and their reader.

Writing: records are dealt into shards by ranges of (id, payload digest), whose bounds come from the rows with the
smallest hashes, so they depend on the rows alone and not on how these lie in files. A task sorts its shards and writes
each as gzip members into files, the next one once a file has reached ``roll`` compressed bytes. Record ids, HTTP headers,
lengths and digests are made anew from the rows, so equal rows give equal bytes. Files are written under temporary names
and renamed, then the manifest of their shard; the archive's own manifest comes last, and what it doesn't count isn't
read. A task that runs again, or twice at a time, writes the same bytes under the same names.

Of records whose payloads are equal and at least ``least`` bytes long, the one with the largest id is the response, and the
others are revisits of it. Which they are is found on digests alone; a decision travels to the shard of its record as a
small row that is sorted before it, so that payloads are shuffled once.

Reading: the files that the manifests name are dealt out, each is read member by member, and payloads and digests are
checked against the headers.

Files are opened with pyarrow's file systems (local paths, file:, hdfs:, s3:, gs:).

Defined results: a null payload is empty; a null id is written as no id header and read as null; it is a response only if
no equal payload has an id; of repeated rows, the first one is the response and the others revisit it; a null or empty URL
has no header and is read as null; control characters in a URL are percent-encoded; an empty table gives an archive
without files; extra columns are ignored. A payload must fit in memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.batches import parts, quoted, small_batches
from shelfmark.llm.hot import join_one
from shelfmark.llm.shared import shared_folder, stored

#: Compressed bytes after which a file is rolled, payload bytes of a shard, and the fewest shards.
ROLL, SHARD, SHARDS = 256 << 20, 512 << 20, 64
#: Keys, those with the smallest hashes, from which the bounds of shards are taken.
SAMPLE = 20_000
#: Equal payloads of so many bytes are stored once.
LEAST = 1000
DATE = "1970-01-01T00:00:00Z"
RECORD_SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, file string, offset long"
)


def _names(spark: SparkSession, folder: str) -> str:
    """``folder`` as an address that tasks can open."""
    return folder if re.match("^[a-z0-9]+:", folder) else f"file://{folder}"


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))


def record_id(page_id: int | None, digest: str, kind: str, number: int) -> str:
    """The address of a record, from what it holds; ``number`` tells repeated rows apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{kind}/{number}')}>"


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    headers = [*headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in headers) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", level, mtime=0)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_url(url: str) -> str:
    return re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_record(row: dict, first: bool, number: int, date: str, level: int) -> tuple[str, bytes]:
    """Kind and bytes of a page's record. ``row``: page_id, url, payload, digest, to, to_url; ``first``: no equal row came before."""
    payload, digest = row["payload"], row["digest"]
    named = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    revisit = row["decided"] or not first
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "revisit" if revisit else "response"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(row["page_id"], digest, kind, number)), ("WARC-Date", date)]
    if row["url"]:
        headers.append(("WARC-Target-URI", safe_url(row["url"])))
    if row["page_id"] is not None:
        headers.append(("Page-ID", str(row["page_id"])))
    headers.append(("Content-Type", "application/http; msgtype=response"))
    headers.append(("WARC-Payload-Digest", named))
    if revisit:
        to, to_url = (row["to"], row["to_url"]) if row["decided"] else (row["page_id"], row["url"])
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        headers.append(("WARC-Refers-To", record_id(to, digest, "response", 0)))
        headers.append(("WARC-Refers-To-Date", date))
        if to_url:
            headers.append(("WARC-Refers-To-Target-URI", safe_url(to_url)))
        if to is not None:
            headers.append(("Refers-To-Page-ID", str(to)))
    block = http if revisit else http + payload
    return kind, _member([*headers, ("WARC-Block-Digest", _sha1(block))], block, level)


class _Writer:
    """The files of one shard."""

    def __init__(self, folder: str, shard: int, roll: int, level: int, date: str):
        self.fs, self.path = _opened(folder)
        self.shard, self.roll, self.level, self.date = shard, roll, level, date
        self.attempt, self.files, self.out = uuid.uuid4().hex, [], None
        self.fs.create_dir(f"{self.path}/_temporary/{self.attempt}", recursive=True)

    def write(self, member: bytes, kind: str) -> None:
        if self.out is None:
            name = f"part-{self.shard:06d}-{len(self.files):04d}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.path}/_temporary/{self.attempt}/{name}", compression=None)
            self.files.append({"name": name, "bytes": 0, "response": 0, "revisit": 0, "sha256": hashlib.sha256()})
            about = f"software: shelfmark\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
            ids = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name, "warcinfo", 0)), ("WARC-Date", self.date), ("WARC-Filename", name)]
            self._put(_member([*ids, ("Content-Type", "application/warc-fields")], about, self.level))
        self._put(member)
        self.files[-1][kind] += 1
        if self.files[-1]["bytes"] >= self.roll:
            self._close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.files[-1]["bytes"] += len(data)
        self.files[-1]["sha256"].update(data)

    def _close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def commit(self) -> dict:
        """Gives the files their names, then the shard its manifest."""
        self._close()
        files = [f | {"sha256": f["sha256"].hexdigest()} for f in self.files]
        for f in files:
            publish(self.fs, f"{self.path}/_temporary/{self.attempt}/{f['name']}", f"{self.path}/{f['name']}")
        put_text(self.fs, f"{self.path}/manifests/shard-{self.shard:06d}.json", "".join(json.dumps(f) + "\n" for f in files))
        self.fs.delete_dir(f"{self.path}/_temporary/{self.attempt}")
        return {"shard": self.shard, "files": len(files), "records": sum(f["response"] + f["revisit"] for f in files), "bytes": sum(f["bytes"] for f in files)}


def publish(files, source: str, target: str) -> None:
    """Renames; an equal file of another attempt may be there already."""
    from pyarrow import fs

    try:
        files.move(source, target)
    except OSError:
        if files.get_file_info(target).type == fs.FileType.NotFound:
            raise


def put_text(files, path: str, text: str) -> None:
    """Writes under a temporary name and renames."""
    files.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temporary) as out:
        out.write(text.encode())
    publish(files, temporary, path)


def shard_bounds(keys: DataFrame, n: int, shards: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Keys (id, digest as a number) at which shards 1, 2, ... begin: quantiles of the keys with the smallest hashes.

    ``n``: how many keys there are; only hashes below a bound that about twice the sample meets are put in order.
    """
    low = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * SAMPLE // max(n, 1))
    hashed = keys.withColumn("hash", F.xxhash64("id", "tie")).where(F.col("hash") <= low)
    chosen = hashed.orderBy("hash", "id", "tie").limit(SAMPLE).collect()
    ordered = sorted((r.id, r.tie) for r in chosen)
    cuts = sorted({ordered[len(ordered) * s // shards] for s in range(1, shards)} if ordered else set())
    return np.array([c[0] for c in cuts], np.int64), cuts


def shard_of(ids: np.ndarray, ties: np.ndarray, bounds: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    import bisect

    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    for i in np.flatnonzero(low != high).tolist():  # bounds with this very id: the digest decides
        low[i] = bisect.bisect_right(cuts, (int(ids[i]), int(ties[i])))
    return low.astype(np.int32)


def write_warc(
    pages: DataFrame, folder: str, least: int = LEAST, roll: int = ROLL, shard_bytes: int = SHARD, shards: int = SHARDS, date: str = DATE, level: int = 6
) -> DataFrame:
    """Writes an archive of ``pages`` (page_id, url, html) to ``folder``; gives shard, files, records, bytes of each shard.

    ``shards``: the fewest; there are more once the payloads exceed ``shard_bytes`` for each.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = _names(spark, folder)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    # 256 bits say whether payloads are equal; the 160 bits of the archive's digests can be forged.
    keys = stored(rows.select("page_id", "url", F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("equal"), F.octet_length("payload").alias("size")), "payload-keys")
    ranged = keys.select(F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("digest").alias("tie"))
    sums = keys.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    bounds, cuts = shard_bounds(ranged, sums.n, max(shards, -(-(sums.bytes or 0) // shard_bytes)))

    long = keys.where(F.col("size") >= least)
    winner = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))), F.coalesce("url", F.lit("")))
    groups = long.groupBy("equal").agg(F.count("*").alias("copies"), F.max("page_id").alias("to"), F.max_by("url", winner).alias("to_url"))
    repeated = groups.where(F.col("copies") > 1).drop("copies")
    revisits = join_one(long, repeated, "equal").where(F.col("to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to")))
    none = F.lit(None)
    decisions = revisits.select(
        "page_id", none.cast("string").alias("url"), none.cast("binary").alias("payload"), "digest", F.lit(0).alias("kind"), "to", "to_url",
    )
    records = rows.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.lit(1).alias("kind"), none.cast("long").alias("to"), none.cast("string").alias("to_url"))

    @F.pandas_udf("int")
    def shard(ids, ties):
        import pandas as pd

        return pd.Series(shard_of(ids.to_numpy(np.int64), ties.to_numpy(np.int64), bounds, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, decided, before, repeat, done = None, None, None, 0, []
        for batch in parts(batches, 64):
            for row in batch.to_pylist():
                if writer is None or writer.shard != row["shard"]:
                    if writer:
                        done.append(writer.commit())
                    writer, before = _Writer(folder, row["shard"], roll, level, date), None
                key = (row["page_id"], row["digest"])
                if row["kind"] == 0:
                    decided = (key, row["to"], row["to_url"])
                    continue
                repeat = repeat + 1 if key == before else 0
                before = key
                own = decided and decided[0] == key
                row |= {"decided": bool(own), "to": decided[1] if own else None, "to_url": decided[2] if own else None}
                first = repeat == 0 or len(row["payload"]) < least
                kind, member = page_record(row, first, repeat, date, level)
                writer.write(member, kind)
        if writer:
            done.append(writer.commit())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("files", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64())]))

    both = decisions.unionByName(records)
    placed = both.withColumn("shard", shard(F.coalesce("page_id", F.lit(-(1 << 63))), F.xxhash64("digest")))
    n = len(cuts) + 1
    sorted_ = placed.repartition(n, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    written = stored(sorted_.mapInArrow(run, "shard int, files int, records long, bytes long"), "warc-shards")
    # A shard that was written twice is listed once for each task that ended well; all say the same.
    sums = written.dropDuplicates(["shard"]).agg(F.count("*").alias("shards"), F.sum("files").alias("files"), F.sum("records").alias("records")).first()
    files, path = _opened(folder)
    files.create_dir(f"{path}/_temporary", recursive=True)
    files.delete_dir(f"{path}/_temporary")  # what failed attempts left
    put_text(files, f"{path}/MANIFEST.json", json.dumps({"shards": sums.shards, "files": sums.files or 0, "records": sums.records or 0, "bounds": len(cuts)}) + "\n")
    return written


def members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream."""
    start, data = 0, b""
    while True:
        unzip, out, used = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            data = data or stream.read(1 << 20)
            if not data:
                if used:
                    raise ValueError(f"the member at {start} ends too early")
                return
            out.append(unzip.decompress(data))
            used += len(data) - len(unzip.unused_data)
            data = unzip.unused_data
        yield start, b"".join(out)
        start += used


def parse_record(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a block has another length than its header says")
    return headers, rest[:size]


def read_record(content: bytes) -> dict | None:
    """What a record says of its page, checked against its digests; None for one that is of no page."""
    headers, block = parse_record(content)
    if headers["warc-type"] not in ("response", "revisit"):
        return None
    if headers.get("warc-block-digest", "") not in ("", _sha1(block)):
        raise ValueError(f"block digest of {headers['warc-record-id']} is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = headers["warc-payload-digest"]
    if headers["warc-type"] == "response" and (len(payload) != size or _sha1(payload) != digest):
        raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
    number = lambda name: int(headers[name]) if name in headers else None
    return {
        "page_id": number("page-id"), "url": headers.get("warc-target-uri"), "record_type": headers["warc-type"], "refers_to": number("refers-to-page-id"),
        "payload": payload if headers["warc-type"] == "response" else None, "payload_bytes": size,
        "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(),
    }


def read_warc(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The records of pages of an archive, in no order: RECORD_SCHEMA, or these ``columns`` of it.

    Raises if the archive has no manifest (it was not finished), or if a shard's is missing.
    """
    folder = _names(spark, folder)
    files, path = _opened(folder)
    with files.open_input_stream(f"{path}/MANIFEST.json") as said:
        manifest = json.loads(said.read())
    fields = [f.split() for f in RECORD_SCHEMA.split(", ") if columns is None or f.split()[0] in columns]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields)
    if not manifest["files"]:
        return spark.createDataFrame([], schema)
    names = spark.read.schema("name string, bytes long, response long, revisit long, sha256 string").json(f"{folder}/manifests")
    found = names.agg(F.count("*"), F.sum(F.col("response") + F.col("revisit"))).first()
    if tuple(found) != (manifest["files"], manifest["records"]):
        raise ValueError(f"the manifests name {found[0]} files and {found[1]} records, not {manifest['files']} and {manifest['records']}")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _opened(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for offset, content in members(stream):
                        row = read_record(content)
                        if row is None:
                            continue
                        rows.append({k: v for k, v in (row | {"file": name, "offset": offset}).items() if k in arrow.names})
                        size += len(content) if "payload" in arrow.names else 100
                        if size > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    dealt = names.select("name").repartition(min(manifest["files"], 1 << 15), "name")
    return dealt.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` to a new archive in the shared folder and reads it back without payloads."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, folder, **options)
    wanted = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read_warc(spark, folder, wanted).select(*quoted(wanted))

"""WARC archives: what is written, that it can be read back, and that damage is noticed."""

import gzip
import hashlib
import json
import os

import pytest

from shelfmark.llm import warc

LONG = "é<p>" * 400_000
PAGES = [
    (1, "http://a/1", "x" * 1200), (2, "http://a/2", "x" * 1200), (3, None, "x" * 1200), (None, "http://n", "x" * 1200), (4, "a\r\nb: c", None),
    (5, "", "y" * 10), (6, "http://q", "y" * 10), (7, "http://q", "z" * 2000), (7, "http://q", "z" * 2000), (None, "a", "w" * 1000), (None, "b", "w" * 1000),
    (8, "http://é/", LONG), (9, "http://l", LONG), (10, "http://m", "\x00퟿" * 600), (-5, "http://m", "v" * 999), (-6, "http://m", "v" * 999),
]
SCHEMA = "page_id long, url string, html string"


@pytest.fixture
def pages(spark):
    rows = [(*p, "x", "y", 1) for p in PAGES]
    return spark.createDataFrame(rows, SCHEMA + ", payload string, shard string, digest int")


def plain(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data]
        last = max((p for p in same if p is not None), default=None)
        kind = "revisit" if len(data) >= 1000 and page_id != last else "response"
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), kind, last if kind == "revisit" else None))
    # Of rows that repeat, and of equal ones without ids, the first is the response.
    for page_id, size in ((7, 2000), (None, 1000)):
        at = [i for i, r in enumerate(out) if r[:2] == (page_id, size)]
        for n, i in enumerate(at):
            out[i] = (*out[i][:3], "revisit" if n else "response", page_id if n else None)
    return sorted(out, key=str)


def test_pages_come_back(spark, pages):
    found = warc.archive_pages(pages)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(PAGES)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_files_roll_and_are_the_same_again(spark, pages, tmp_path):
    held = []
    for name, rows in (("a", pages), ("b", pages.repartition(7))):
        warc.write_warc(rows, str(tmp_path / name), roll=600, shards=3)
        files = sorted(f for f in os.listdir(tmp_path / name) if f.endswith(".gz"))
        held.append({f: (tmp_path / name / f).read_bytes() for f in files})
        assert sorted(os.listdir(tmp_path / name)) == ["MANIFEST.json", *([]), "manifests", *files] or len(files) > 3
        assert not os.path.exists(tmp_path / name / "_temporary")
    assert held[0] == held[1] and len(held[0]) > 3
    said = [json.loads(x) for f in os.listdir(tmp_path / "a/manifests") if f.endswith(".json") for x in open(tmp_path / "a/manifests" / f)]
    for entry in said:
        data = held[0][entry["name"]]
        assert len(data) == entry["bytes"] and hashlib.sha256(data).hexdigest() == entry["sha256"]
        text = gzip.decompress(data)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.count(b"WARC-Record-ID") == 1 + entry["response"] + entry["revisit"]
    rows = warc.read_warc(spark, str(tmp_path / "a")).collect()
    given = {(p, u): h for p, u, h in PAGES}
    assert len(rows) == len(PAGES)
    for r in rows:
        if r.record_type == "response" and r.page_id in (1, 8, 10):
            assert r.payload.decode() == next(h for (p, _), h in given.items() if p == r.page_id)
    assert {r.url for r in rows if r.page_id == 4} == {"a%0D%0Ab:%20c"} and {r.url for r in rows if r.page_id == 5} == {None}
    # Each record can be read from its place alone.
    for r in rows:
        data = held[0][r.file][r.offset :]
        _, content = next(warc.members(__import__("io").BytesIO(data)))
        assert warc.read_record(content)["payload_digest"] == r.payload_digest


def test_an_unfinished_or_damaged_archive_is_refused(spark, pages, tmp_path):
    folder = tmp_path / "a"
    warc.write_warc(pages, str(folder), shards=3)
    shard = next(f for f in os.listdir(folder / "manifests") if f.endswith(".json"))
    kept = (folder / "manifests" / shard).read_text()
    (folder / "manifests" / shard).unlink()
    with pytest.raises(ValueError, match="manifests name"):
        warc.read_warc(spark, str(folder))
    (folder / "manifests" / shard).write_text(kept)
    record = warc.page_record({"page_id": 1, "url": "u", "payload": b"abc", "digest": hashlib.sha1(b"abd").hexdigest(), "decided": False}, True, 0, warc.DATE, 6)
    with pytest.raises(ValueError, match="damaged"):
        warc.read_record(gzip.decompress(record[1]))
    (folder / "MANIFEST.json").unlink()
    with pytest.raises(OSError):
        warc.read_warc(spark, str(folder))


def test_a_record_cut_short_is_noticed():
    import io

    member = gzip.compress(b"x" * 100)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(member + member[:10])))


def test_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []

"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing column names."""

import pytest
from public_tokenizers import PATTERN, path
from pyspark.sql import Row
from pyspark.sql import functions as F

from shelfmark.llm import (
    bpe_codec, ctw, jaccard_join, license_scan, line_crf, packing, quality_rules, top_k, toxicity, url_rules,
)

LONG = "word " * 60_000 + "x" * 300_000 + " " * 1000 + "é" * 1000
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog."),
    (1, "The quick brown fox jumps over the lazy dog."),
    (2, ""),
    (3, None),
    (None, "no id here at all, none"),
    (4, " \t\n "),
    (5, LONG),
    (6, "one two"),
    (7, "ONE two"),
]
LABELS = [(1, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (99, 1, 0)]
DOC_SCHEMA = "doc_id long, text string, h int, a string, b string, words string, score string, bucket string, k string, learn string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*row, *[None] * 8) for row in DOCS], DOC_SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def codec(docs, labels):
    return bpe_codec.round_trip_digests(docs, path("byte_bpe_50k.tiktoken"), PATTERN)


JOBS = {
    "jaccard": lambda d, l: jaccard_join.similar_sets(d),
    "codec": codec,
    "ctw": lambda d, l: ctw.score_documents(d),
    "crf": line_crf.classify_quality,
    "toxicity": toxicity.score_toxicity,
    "licenses": lambda d, l: license_scan.scan_licenses(d),
    "rules": quality_rules.judge_quality,
}


@pytest.mark.parametrize("name", JOBS)
def test_a_row_for_each_document(name, docs, labels):
    found = JOBS[name](docs, labels).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(d[0]) for d in DOCS)
    twice = [r for r in found if r.doc_id == 1]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("name", JOBS)
def test_empty_tables(name, docs, labels):
    assert JOBS[name](docs.limit(0), labels.limit(0)).collect() == []


def test_without_labels(docs, labels):
    assert len(line_crf.classify_quality(docs, labels.limit(0)).collect()) == len(DOCS)
    assert not any(r.is_toxic for r in toxicity.score_toxicity(docs, labels.limit(0)).collect())


def test_packing(docs):
    found = packing.pack_documents(docs, path("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in found} == {d[0] for d in DOCS}
    assert packing.pack_documents(docs.limit(0), path("byte_bpe_50k.json")).collect() == []


def test_encoded_columns_stay(docs):
    coded = bpe_codec.encode_documents(docs, path("byte_bpe_50k.tiktoken"), PATTERN)
    assert coded.columns == [*docs.columns, "token_ids"]
    back = bpe_codec.decode_documents(coded, path("byte_bpe_50k.tiktoken"), PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())


def test_filters_keep_all_columns(docs, labels):
    assert line_crf.filter_quality(docs, labels).columns == docs.columns
    assert toxicity.filter_toxicity(docs, labels).columns == docs.columns


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [3.0]), (8, []), (200, None), (None, [9.0, 9.0])]
    vectors = spark.createDataFrame([Row(vec_id=i, embedding=v, score=0, b=1, q="x") for i, v in rows], "vec_id long, embedding array<double>, score int, b int, q string")
    found = [tuple(r) for r in top_k.exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0)).collect()]
    one = 1024 * 1024
    assert sorted(found) == [(100, 1, 1, 5 * one), (100, 2, 2, 5 * one), (100, 3, 7, 3 * one), (100, 4, 8, 0)]
    assert top_k.exact_top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def test_urls(spark):
    rules = spark.createDataFrame([url_rules.parse_rule("block", "net/es/")], "verdict string, host string, path string")
    urls = [None, "", "no scheme", "http://", "http://net/es/", "HTTP://A.NET/es/x?y#z", "http://net", "http://b.net/es", "x://y.net?/es/", "http://net./es/"]
    pages = spark.createDataFrame([(i, u, "h", "p", "k") for i, u in enumerate([*urls, urls[5]])], "page_id long, url string, host string, path string, key string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules).collect()}
    assert len(found) == 11
    assert found[0] == found[1] == found[2] == found[3] == ("", "", None, "allow")
    assert found[4] == ("net", "/es/", "net/es/", "block")
    assert found[5] == found[10] == ("a.net", "/es/x", "net/es/", "block")
    assert found[6][2] is found[7][2] is found[8][2] is found[9][2] is None
    assert url_rules.judge_urls(pages.limit(0), rules).collect() == []

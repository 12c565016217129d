"""The stored text index: what a search reads, changes, stopped builds, and rows of every kind."""

import math
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.search_index import SearchIndex, search_page

FIELDS = {"title": 10, "brand": 5}
SCHEMA = "k string, title string, brand string, extra string"


def plain_scores(rows, query):
    """Scores by reading all texts."""
    wanted, found = set(re.findall("[a-z0-9]+", query.lower())), {}
    for key, title, brand, _ in rows:
        total = 0.0
        for text, weight in ((title, 10), (brand, 5)):
            words = re.findall("[a-z0-9]+", (text or "").lower())
            total += weight * sum(w in wanted for w in words) / math.sqrt(len(words)) if words else 0
        if total:
            found[key] = round(total, 6)
    return found


def scores(index, query):
    return {r.key: r.score for r in index.search(query).collect()}


ROWS = [("1", "Red lamp, red shade", "Acme", "x"), ("2", "blue lamp", None, "y"), ("3", None, "", "z"), ("4", "", "Lamp-Works 7", None), ("5", "w " * 20000 + "lamp", "é", "long")]


@pytest.fixture
def index(spark, tmp_path):
    made = SearchIndex(spark, str(tmp_path / "index"), FIELDS, buckets=8)
    made.build(spark.createDataFrame(ROWS, SCHEMA), "k")
    return made


@pytest.mark.parametrize("query", ["lamp", "RED lamp", "7 works acme", "nothing", "", " ,. ", "lamp lamp"])
def test_scores(index, query):
    assert scores(index, query) == pytest.approx(plain_scores(ROWS, query))


def test_reads_only_buckets_of_the_words(spark, index):
    found = index.search("lamp")
    bucket = spark.range(1).select(index.bucket(F.lit("lamp"))).first()[0]
    read = {r[0] for r in index._read().where(F.col("bucket").isin([bucket])).select(F.input_file_name()).distinct().collect()}
    assert read and all(f"bucket={bucket}/" in name for name in read)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {bucket}\b", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(term,lamp\)", plan)
    assert "title" not in plan.split("ReadSchema")[1]


def test_changes_and_compaction(spark, index):
    changed = [("2", "red chair", "Acme", "n"), ("6", "lamp", None, "n")]
    index.change(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([("1",), ("none",), (None,)], "k string"), "k")
    index.change(spark.createDataFrame([("4", "lamp lamp", None, "n")], SCHEMA), spark.createDataFrame([], "k string"), "k")
    now = changed + [("4", "lamp lamp", None, "n")] + [r for r in ROWS if r[0] in "35"]
    for _ in range(2):
        for query in ("lamp", "red acme", "works"):
            assert scores(index, query) == pytest.approx(plain_scores(now, query))
        index.compact()
    assert len(index.segments()) == 1


def test_stopped_change_is_not_read(spark, index, monkeypatch):
    before = scores(index, "lamp")
    change = (spark.createDataFrame([("2", "chair", None, "n")], SCHEMA), spark.createDataFrame([("1",)], "k string"), "k")
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            index.change(*change)
    assert scores(index, "lamp") == before
    index.change(*change)
    assert set(scores(index, "lamp")) == set(before) - {"1", "2"}


def test_keys_and_empty_tables(spark, tmp_path):
    empty = SearchIndex(spark, str(tmp_path / "empty"), FIELDS)
    empty.build(spark.createDataFrame([], SCHEMA), "k")
    assert scores(empty, "lamp") == {}
    empty.change(spark.createDataFrame(ROWS[:1] * 3 + [(None, "lamp", "b", "c"), ("1", "z lamp", "z", "z")], SCHEMA), spark.createDataFrame([], "k string"), "k")
    assert scores(empty, "red lamp") == pytest.approx(plain_scores(ROWS[:1], "red lamp"))


def test_page_order(spark):
    matches = spark.createDataFrame([("a", 1.234), ("b", 2.0), ("c", 2.0), ("gone", 9.0)], "key string, score double")
    rows = spark.createDataFrame([("a", 3.0, 4.0), ("b", None, 1.0), ("c", 1.0, 9.0)], "canonicalId string, priceMin double, priceMax double")
    ids = lambda *a: [r.canonicalId for r in search_page(matches, rows, *a).collect()]
    assert ids() == ["b", "c", "a"] and ids("price_asc") == ["b", "c", "a"] and ids("price_desc") == ["c", "a", "b"]
    assert ids("relevance", 2, 2) == ["a"] and search_page(matches, rows, "other", 2, 2).first().score == 1.23

"""Labelled cases of the catalog rules, and the queries beside their SQL."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfmark.functions import exprs as X
from shelfmark.operators import resolve as R
from shelfmark.operators import survive as S
from shelfmark.operators import upsert as U
from shelfmark.plans import views

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_canonical_ids(spark):
    rows = [("Apple iPhone 13", "Apple"), ("Samsung Galaxy S22", "Samsung"), ("", "Apple")]
    found = spark.createDataFrame(rows, "title string, brand string").select(X.canonical_id(F.col("title"), F.col("brand"))).collect()
    assert [r[0] for r in found] == ["cprod_259dfdc638a7de3b6de2e7ae", "cprod_35c27d1ae4dc38f246915c3f", None]


@pytest.mark.parametrize(
    "a, b, title, score",
    [
        (("Nike Air Max 90", "Nike", 10999, "Shoes"), ("Nike Airmax 90", "Nike", 10999, "Shoes"), 1, 1),
        (("Classic Cotton T-Shirt", None, 499, "Apparel"), ("Classic Cotton T-Shirt", None, 520, "Apparel"), 1, 0.887885),
        (("Apple iPhone 13", "Apple", 55999, "Phones"), ("Apple iPhone 13 Black", "Apple", 60500, "Phones"), 0.722222, 0.866570),
        (("Samsung Galaxy S22", "Samsung", 65000, "Phones"), ("Nike Air Max 90", "Nike", 9999, "Shoes"), 0.3125, 0),
        (("Cotton T-Shirt Size M", "Acme", 499, "Apparel"), ("Cotton T-Shirt Size XL", "Acme", 499, "Apparel"), 0.894737, 0.957895),
        (("Organic Face Wash", "BrandA", 349, "Skincare"), ("Herbal Face Wash", "BrandB", 349, "Skincare"), 0.666667, 0.666667),
        (("Bluetooth Speaker Mini", "SoundMax", 1999, "Electronics"), ("Bluetooth Speaker Mini", "SoundMax", 3200, "Electronics"), 1, 0),
    ],
)
def test_dedup_scores(spark, a, b, title, score):
    schema = "title string, brand string, price double, category string"
    x, y = (spark.createDataFrame([(t, n, float(p), c)], schema) for t, n, p, c in (a, b))
    side = lambda df, s: df.select(
        X.char_histogram(X.text_normalize(F.col("title"))).alias(f"h{s}"), X.brand_normalize(F.col("brand")).alias(f"b{s}"),
        X.text_normalize(F.col("category")).alias(f"c{s}"), F.col("price").alias(f"p{s}"), F.lit(1).alias("k"),
    )
    similarity = X.histogram_similarity(F.col("h1"), F.col("h2"))
    total = X.dedup_score(similarity, X.brand_match(F.col("b1"), F.col("b2")), X.category_match(F.col("c1"), F.col("c2")), F.col("p1"), F.col("p2"))
    found = side(x, 1).join(side(y, 2), "k").select(similarity.alias("t"), total.alias("s")).first()
    assert found.t == pytest.approx(title, abs=1e-6) and found.s == pytest.approx(score, abs=1e-6)


@pytest.mark.parametrize("text, amount, currency", [("₹1,299", 1299, "INR"), ("$12.99", 12.99, "USD"), ("1,299.00 INR", 1299, "INR"), ("Rs. 499", 499, "INR"), ("USD 12.99", 12.99, "USD")])
def test_prices(spark, text, amount, currency):
    found = one(spark, p=X.price_normalize(F.lit(text))).p
    assert (found.amount, found.currency) == (amount, currency)


@pytest.mark.parametrize("quantity, state", [(50, "in_stock"), (5, "limited"), (0, "out_of_stock"), (10, "limited"), (None, "in_stock")])
def test_availability(spark, quantity, state):
    assert one(spark, a=X.availability_threshold(F.lit(quantity).cast("int"))).a == state


@pytest.mark.parametrize(
    "e, i, pe, pi, te, ti, winner, reason",
    [
        ("a", "b", 1, 6, 1, 2, "existing", "source_priority"),
        (None, "b", 1, 6, 1, 2, "incoming", "null_fallback"),
        ("a", "b", 2, 2, 1, 2, "incoming", "recency"),
        ("a", "bb", 2, 2, 1, 1, "incoming", "completeness"),
        ("a", " ", 6, 1, 1, 2, "existing", "null_fallback"),
    ],
)
def test_resolve_field(spark, e, i, pe, pi, te, ti, winner, reason):
    row = spark.createDataFrame([(e, i, pe, pi, te, ti)], "e string, i string, pe int, pi int, te long, ti long")
    found = row.select(S.resolve_field("e", "i").alias("r")).first().r
    assert (found.winner, found.reason) == (winner, reason)


def test_accuracy(spark):
    products = views.products(spark, SF)
    pairs = R.entity_pairs(products).select(F.col("id").alias("a"), F.col("match").alias("b"), F.lit(True).alias("expected"))
    found = R.accuracy_eval(pairs, products).first()
    assert found.pairs == pairs.count() and found.falseNegatives == 0 and (found.accuracy == 1 or found.pairs == 0)


def test_upserts_repeat(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (None, "x", 4), (3, "e", 1)], "k int, v string, t int")
    once = U.upsert_replace(old, new, ["k"], "t")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert sorted(map(tuple, U.upsert_replace(once, new, ["k"], "t").collect())) == sorted(map(tuple, once.collect()))
    sets = spark.createDataFrame([(1, ["x"]), (2, None)], "k int, c array<string>")
    links = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, c string")
    assert {r.k: r.c for r in U.add_to_set(sets, links, "k", "c").collect()} == {1: ["x", "y"], 2: ["z"]}


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return repr(int(value)) if isinstance(value, (bool, int)) else None if value is None else str(value)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_beside_sql(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    expected = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(columns)
    rows = sorted(repr([plain(v) for v in r]) for r in found.select(*[f"`{c}`" for c in columns]).collect())
    assert rows == sorted(repr([plain(v) for v in r]) for r in expected.fetchall())

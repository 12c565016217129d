"""Jobs on rows that are repeated, broken, cyclic or missing."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import exprs as X
from shelfmark.operators import categories as K
from shelfmark.operators import resolve as R
from shelfmark.operators import serve as V
from shelfmark.operators import survive as S
from shelfmark.operators import upsert as U


def test_the_last_of_repeated_names_wins(spark):
    rows = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3"), (None, "4")],), ([],), (None,)], "e array<struct<k:string,v:string>>")
    assert [r.m for r in rows.select(X.last_wins(F.col("e")).alias("m")).collect()] == [{"b": "2", "a": "3"}, {}, None]


def test_levels_of_trees_with_cycles_and_unknown_parents(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(40)]
    rows = spark.createDataFrame([*chain, ("x", "y"), ("y", "z"), ("z", "x"), ("lost", "nowhere"), ("under", "lost"), ("self", "self")], "sourceId string, parentSourceId string")
    found = {r.sourceId: r.level for r in K.category_levels(rows).collect()}
    assert all(found[f"c{i}"] == i for i in range(40))
    assert {found[k] for k in ("x", "y", "z", "lost", "under", "self")} == {None}


def test_magento_trees_of_any_depth(spark):
    tree = '{"id": "0", "name": "root", "children_data": [%s]}'
    inner = '{"id": "9", "name": "leaf"}'
    for i in range(8, 0, -1):
        inner = '{"id": "%d", "name": "n%d", "children_data": [%s]}' % (i, i, inner)
    found = {r.sourceId: (r.parentId, r.level) for r in K.norm_magento_categories(spark.createDataFrame([(tree % inner,), ("broken",), (None,)], "tree string")).collect()}
    assert found == {str(i): (str(i - 1) if i > 1 else None, i) for i in range(1, 10)}


def products(spark, n=120):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        title = " ".join(rng.choice(["red", "blue", "ring", "bolt", "widget"]) for _ in range(rng.randint(0, 4)))
        price = rng.choice([None, 0.0, 10.0, 12.0, 14.0, 20.0, 100.0])
        rows.append((f"p{i}", str(i // 2), rng.choice([None, "", "s1", "s2"]), title or None, rng.choice([None, " ", "Acme", "Bolt"]), rng.choice([None, "", "tools", "art"]), price, {"size": str(i % 3)}))
    return spark.createDataFrame(rows, "id string, sourceId string, sku string, title string, brand string, category string, price double, attributes map<string,string>")


@pytest.mark.parametrize("kind", ["dedup", "entity"])
def test_pairs_without_cap_lose_nothing(spark, kind):
    """Every pair whose keys meet and whose score is high enough, from a join of all rows with all."""
    rows = products(spark)
    found = {(r.id, r.match): r.score for r in (R.dedup_pairs if kind == "dedup" else R.entity_pairs)(rows, cap=None, threshold=0.6).collect()}
    f = R.features(rows)
    side = lambda s: f.select(*[F.col(c).alias(f"{c}_{s}") for c in f.columns])
    a, b = {"category": F.col("category_a"), "brand": F.col("brand_a")}, {"category": F.col("category_b"), "brand": F.col("brand_b")}
    has_c, has_b = a["category"] != "", a["brand"].isNotNull()
    words = F.when(F.size("tokens_a") >= 3, F.arrays_overlap(F.slice("tokens_a", 1, 3), "tokens_b"))
    if kind == "dedup":
        meet = F.when(has_c, a["category"] == b["category"]).when(has_b, a["brand"] == b["brand"])
    else:
        meet = (
            F.when(has_c & has_b, (a["category"] == b["category"]) & (a["brand"] == b["brand"])).when(has_b, a["brand"] == b["brand"])
            .when(has_c, a["category"] == b["category"]).otherwise(words)
        )
    every = R._gated(side("a").crossJoin(side("b"))).where(meet)
    title, brand, category = R._signals()
    prices = F.col("price_a"), F.col("price_b")
    scored = R.similar(every, 0.0)
    if kind == "dedup":
        score = X.dedup_score(title, brand, category, *prices)
    else:
        score = X.entity_score(title, brand, category, X.attribute_similarity(F.col("attributes_a"), F.col("attributes_b")), *prices, F.col("sku_a"), F.col("sku_b"))
    expected = {(r.id_a, r.id_b): r.score for r in scored.select("id_a", "id_b", F.round(score, 6).alias("score")).where("score >= 0.6").collect()}
    assert found == expected and len(found) > 50


def test_capped_candidates_find_most_matches(spark):
    """Recall of the capped form against the form without a cap."""
    from shelfmark.plans import views

    rows = views.products(spark, "/root/testdata/sf0.01")
    capped, whole = ({(r.id, r.match) for r in R.dedup_pairs(rows, cap=cap).collect()} for cap in (100, None))
    assert capped <= whole
    assert len(capped) >= 0.25 * len(whole) > 0  # which is why the form without a cap exists


def test_offers_of_repeated_keys(spark):
    old = spark.createDataFrame([("s", "t", "v0", "p0", 9.0), ("s", "t", None, "p0", 8.0)], "sourceId string, storeId string, variantId string, productId string, price double")
    new = spark.createDataFrame([("s", "t", "v1", 5.0), ("s", "t", "v1", 4.0), ("s", None, "v1", 1.0)], "sourceId string, storeId string, variantId string, price double")
    known = spark.createDataFrame([("s", "t", "p2"), ("s", "t", "p1")], "sourceId string, storeId string, id string")
    found = sorted((r.variantId, r.productId, r.price) for r in U.upsert_offer_keys(old, new, known).collect())
    assert found == [("v0", "p0", 9.0), ("v1", "p1", 4.0)]


def test_secrets_at_any_depth(spark):
    rows = spark.createDataFrame([('{"a": [{"Auth-token": 1, "b": {"apiKey": {"c": 2}}}]}',), ("no json",), (None,)], "j string")
    found = [r.j for r in V.redact_json(rows, "j").collect()]
    assert found == ['{"a":[{"Auth-token":"[REDACTED]","b":{"apiKey":"[REDACTED]"}}]}', "no json", None]


def test_variants_and_attributes_are_merged_in_order(spark):
    schema = "id string, canonicalProductId string, source string, lastSyncedAt timestamp, variants array<struct<variantId:string,sku:string,price:double>>, attributes map<string,string>, images array<string>"
    rows = spark.sql("SELECT timestamp'2024-01-01' t").first().t
    data = [
        ("b", "c", "magento", rows, [("v1", None, 2.0), (None, "S", 3.0)], {"size": "M", "fit": ""}, ["y", "x"]),
        ("a", "c", "scraped", rows, [("v1", None, 1.0), (None, None, 4.0)], {"size": "L", "fit": " slim"}, ["x", " "]),
        ("z", None, "shopify", rows, [("v9", None, 1.0)], {}, None),
    ]
    known = spark.createDataFrame(data, schema)
    merged = S.merged_variants(known).first().variants
    assert [(v.variantId, v.sku, v.price) for v in merged] == [("v1", None, 1.0), (None, None, 4.0), (None, "S", 3.0)]
    assert {r.key: r.value for r in S.merged_attributes(known).collect()} == {"size": "L", "fit": " slim"}
    assert {r.key: r.value for r in S.golden_attributes(known).collect()} == {"size": "M", "fit": "slim"}
    assert [r.url for r in S.golden_images(known).orderBy("position").collect()] == ["y", "x"]


def test_ranges_of_prices(spark):
    rows = spark.createDataFrame([([(None, "EUR"), (2.0, " "), (1.0, "USD")],), ([(None, "EUR")],), ([],), (None,)], "v array<struct<price:double,currency:string>>")
    found = [tuple(r.p) for r in rows.select(X.price_range(F.col("v")).alias("p")).collect()]
    assert found == [(1.0, 2.0, "EUR"), (None, None, None), (None, None, None), (None, None, None)]


def test_repeated_categories_come_out_as_often_as_they_came_in(spark):
    rows = [(str(i), str(i - 1) if i else None, f"c{i}", f"/c{i}/") for i in range(8)] * 2 + [(None, "1", "x", "/x/"), ("d", "0", "a", "/a/"), ("d", "1", "b", "/b/")]
    given = spark.createDataFrame(rows, "sourceId string, parentSourceId string, name string, url string")
    found = K.norm_bigcommerce_categories(given).collect()
    assert sorted((r.sourceId, r.name) for r in found if r.sourceId) == sorted((r[0], r[2]) for r in rows if r[0]) and len(found) == len(rows)
    # Parent 0 is none, so category 1 is a root as well.
    assert {r.sourceId: r.level for r in found if r.sourceId and len(r.sourceId) == 1 and r.sourceId != "d"} == {"0": 0, **{str(i): i - 1 for i in range(1, 8)}}
    assert K.join_parent_category(given.drop("url")).count() == len(rows)

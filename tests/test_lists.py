"""Lists of classes meet and numpy scores them: no result depends on their length, and best matches hold few rows."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import meetings as M
from shelfmark.operators import resolve as R
from test_dirty import products

JOBS = [R.dedup_pairs, R.best_dedup, R.entity_pairs, R.best_entity]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_lists_of_any_length(spark, monkeypatch, threshold):
    rows = products(spark, 90)
    whole = [rows_of(job(rows, None, threshold)) for job in JOBS]
    for name, number in (("LIST", 3), ("LIST_ROWS", 4), ("CHUNK", 1)):
        monkeypatch.setattr(M, name, number)
    assert [rows_of(job(rows, None, threshold)) for job in JOBS] == whole and all(whole)


def test_best_matches_hold_few_rows(spark, monkeypatch):
    """Products of a block that all match each other: each keeps the best rows of a list, not all of its pairs."""
    n, met, meet = 300, [], M.meet
    alike = [(f"p{i:03}", f"s{i}", None, f"red ring {'abc'[i % 3]}", "Acme", "art", 100.0 + i * i % 97 / 10, {"size": "1"}) for i in range(n)]
    rows = spark.createDataFrame(alike, products(spark, 1).schema)
    monkeypatch.setattr(M, "meet", lambda *a: met.append(meet(*a)) or met[-1])
    for pairs, best in ((R.dedup_pairs, R.best_dedup), (R.entity_pairs, R.best_entity)):
        assert rows_of(best(rows, None)) == rows_of(R.best_match(pairs(rows, None)))
        few, many = (met.pop(0).count() for _ in range(2))
        assert few <= 3 * n and many > n * n / 3


def test_bounds_hold_for_every_row(spark):
    """A class of which rows share a source with what is nearest to it, and SKUs that may not meet."""
    rng = random.Random(5)
    rows = [(f"p{i}", f"s{rng.randrange(6)}", rng.choice([None, None, "x", "y"]), rng.choice(["red ring", "ring red", "red rings"]), rng.choice(["Acme", None]), "art",
             rng.choice([None, 0.0, -1.0, 10.0, 10.5, 11.0, float("nan"), float("inf")]), {"size": rng.choice(["1", "2"])}) for i in range(150)]
    rows = spark.createDataFrame(rows, products(spark, 1).schema)
    for pairs, best in ((R.dedup_pairs, R.best_dedup), (R.entity_pairs, R.best_entity)):
        found = rows_of(best(rows, None))
        assert found == rows_of(R.best_match(pairs(rows, None))) and len(found) > 50


def test_scores_round_as_spark(spark):
    rng = random.Random(4)
    numbers = [0.0, 1.0, 0.8000005, 0.7999995, 0.8125005, 0.9999995, *[rng.randrange(10**7) / 1e7 for _ in range(500)], *[rng.random() for _ in range(500)]]
    found = spark.createDataFrame([(x,) for x in numbers], "x double").select(F.round("x", 6)).collect()
    assert [r[0] for r in found] == M._rounded(M.np.array(numbers)).tolist()


def test_portions_and_ranges():
    counts = M.np.array([0, 3, M.AT_ONCE + 5, 0, 2, M.AT_ONCE - 2, 1])
    parts = list(M._portions(counts))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(len(counts)))
    assert all(counts[p].sum() <= M.AT_ONCE or p.stop - p.start == 1 for p in parts)
    of, place = M._ragged(M.np.array([5, 0, 9]), M.np.array([2, 0, 3]))
    assert of.tolist() == [0, 0, 2, 2, 2] and place.tolist() == [5, 6, 9, 10, 11]


def test_pairs_are_not_shuffled(spark):
    """Pairs of rows leave the tasks that find them; nothing joins or shuffles them."""
    plan = R.dedup_pairs(products(spark, 40), None)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    met = next(i for i, line in enumerate(plan) if "MapInArrow" in line)
    assert not [line for line in plan[:met] if "Join" in line or "Repartition" in line or "Aggregate" in line]


def test_entity_pairs_are_not_shuffled(spark):
    """The same of the pairs by score; those by equal SKUs are few, and come beside them."""
    plan = R.entity_pairs(products(spark, 40), None)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    met, beside = (next(i for i, line in enumerate(plan) if word in line) for word in ("MapInArrow", "Union"))
    assert beside < met and not [line for line in plan[:met] if "Join" in line or "Repartition" in line or "Aggregate" in line]


def test_mean_confidence_holds_few_rows(spark, monkeypatch):
    """The mean needs each product's best score, not all that a block gives."""
    n, met, meet = 200, [], M.meet
    rows = [(f"p{i:03}", f"s{i}", None, "red ring", "Acme", "art", 100.0 + i / 10, {"size": "1"}) for i in range(n)]
    monkeypatch.setattr(M, "meet", lambda *a: met.append(meet(*a)) or met[-1])
    found = R.mean_confidence(R.entity_resolve_all(spark.createDataFrame(rows, products(spark, 1).schema), None)).first()
    assert found.resolved == n and found.meanConfidence > 0.999 and met[0].count() <= 3 * n


def test_incoming_products_hold_few_rows(spark, monkeypatch):
    """Incoming products are resolved from each one's best rows, not from all that a block gives."""
    n, met, meet = 200, [], M.meet
    rows = [(f"p{i:03}", f"s{i}", None, "red ring", "Acme", "art", 100.0 + i / 10, {"size": "1"}) for i in range(n)]
    rows = spark.createDataFrame(rows, products(spark, 1).schema)
    monkeypatch.setattr(M, "meet", lambda *a: met.append(meet(*a)) or met[-1])
    found = R.resolve_incoming(rows.withColumn("canonicalProductId", F.when(F.col("id") == "p007", "cprod_7")), rows).groupBy("matchKind").count().collect()
    assert {tuple(r) for r in found} == {("canonical", 1), ("scored", n - 1)} and met[0].count() <= 3 * n


def test_resolution_holds_few_rows(spark, monkeypatch):
    """Every product is resolved from each one's best rows, whether lists are long or short."""
    n, met, meet = 150, [], M.meet
    rows = [(f"p{i:03}", f"s{i}", None, "red ring", "Acme", "art", 100.0 + i / 10, {"size": "1"}) for i in range(n)]
    rows = spark.createDataFrame([*rows, ("q", "q", None, "red ring", None, None, 100.0, {"size": "1"})], products(spark, 1).schema)
    monkeypatch.setattr(M, "meet", lambda *a: met.append(meet(*a)) or met[-1])
    found = R.resolution_summary(R.entity_resolve_all(rows, None)).first()
    assert tuple(found) == (n + 1, n, 0, 1, 1.0) and met[0].count() <= 3 * n


def test_lists_are_bounded(spark, monkeypatch):
    """A block's classes come in lists, one title's too if they are many, and none is lost."""
    monkeypatch.setattr(M, "LIST", 20)
    kinds = spark.createDataFrame([(f"c{i}", f"l{i % 90}" if i < 180 else "same", 10.0) for i in range(300)], "class string, look string, price double")
    lists = M._lists(kinds, F.array(F.lit("b")), 0.3, ["class", "look"], None).select(F.transform("list", lambda e: e["class"]).alias("c")).collect()
    assert sorted(c for r in lists for c in r.c) == sorted(f"c{i}" for i in range(300)) and max(len(r.c) for r in lists) <= 60

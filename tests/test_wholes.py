"""Queries that did a part of their job only."""

from pyspark.sql import functions as F

from shelfmark.operators import serve as V
from shelfmark.plans import queries as P

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_entity_pairs_beyond_the_first_candidates(spark, tmp_path):
    """All rows of a block of more than 200 match each other."""
    keys = [k for k in range(1, 400) if k % 4 and k % 10 and k % 17 and k % 41]
    spark.createDataFrame([(k, "red ring", "Brand#1", "LARGE", 7, 900.0) for k in keys], PART).write.parquet(str(tmp_path / "part.parquet"))
    found = P.QUERIES["entity_pairs"](spark, str(tmp_path))
    assert len(keys) > 200 and found.agg(F.count("*"), F.count_distinct("id", "match")).first() == (len(keys) * (len(keys) - 1),) * 2


def test_price_context_names_all_stores(spark):
    """The others by price, those without one last; words of its own for an offer that is alone."""
    offer = lambda c, i, store, price, currency="EUR", stocked=True: (f"o{i}", c, f"s{store}", price, currency, stocked)
    rows = [offer("a", 1, 2, 5.0), offer("a", 2, 1, 3.0), offer("a", 3, 9, None), offer("a", 4, 2, 4.0), offer("a", 5, 1, 1.0, stocked=False)]
    rows += [offer("b", 6, 1, 2.0, None), offer("b", 7, 2, 1.0, stocked=False), offer("c", 8, 1, 2.0, stocked=False), offer("f", 9, 9, None), (*offer(None, 10, 1, 1.0),)]
    offers = spark.createDataFrame(rows, "id string, canonicalProductId string, storeId string, price double, currency string, isInStock boolean")
    canonical = spark.createDataFrame([(c, 7.0 if c == "d" else None, None) for c in "abcdef"], "canonicalId string, priceMin double, currency string")
    stores = spark.createDataFrame([("s1", "One"), ("s2", "Two")], "id string, name string")
    found = V.ai_price_context(canonical, offers, stores, alone="Available at").collect()
    assert {r.canonicalId: r.context for r in found} == {
        "a": "Cheapest at One for 3.00 EUR, also available at Two, Two, Unknown Store", "b": "Available at One for 2.00 USD", "c": "Out of stock at all stores",
        "d": "Listed from 7.00 USD", "e": "Price unavailable", "f": "Available at Unknown Store for 0.00 EUR",
    }

"""Last arrivals over many batches, and inventory patches by SKU and store."""

import datetime

from pyspark.sql import functions as F

from shelfmark.operators import normalize as N
from shelfmark.streaming import handlers as H
from shelfmark.streaming.commits import CommitLog

EVENT = "user_id long, event_id long, ts timestamp, received timestamp, topic string"
AT = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)


def held(log):
    return sorted((r.user_id, r.event_id, r.topic) for r in log.read("latest").collect())


def test_last_arrival_wins_and_old_ones_go(spark, tmp_path):
    """Also one that speaks of an older time; the state is a row a key however many batches come."""
    log = CommitLog(spark, f"file://{tmp_path}", {"latest": "user_id"}, 2)
    log.begin({"latest": spark.createDataFrame([], EVENT)})
    handle = H.latest_arrivals("latest", "user_id", 24)
    batches = [
        [(1, 1, AT(9), AT(0), "new"), (1, 2, AT(3), AT(1), "older time"), (2, 3, None, AT(1), "two"), (None, 4, AT(0), AT(1), "none")],
        [(1, 6, AT(0), AT(2), "same moment, later id"), (1, 5, AT(8), AT(2), "same moment"), (3, 7, AT(1), AT(2), "three"), (3, 7, AT(1), AT(2), "three")],
        [],
    ] + [[(4, 10 + n, AT(n), AT(3 + n), "many")] for n in range(6)]
    for n, rows in enumerate(batches):
        log.apply(n, lambda tx: handle(tx, spark.createDataFrame(rows, EVENT)))
        log.apply(n, lambda tx: handle(tx, spark.createDataFrame([(1, 99, AT(0), AT(9), "again")], EVENT)))  # a repeated batch does nothing
    assert held(log) == [(1, 6, "same moment, later id"), (2, 3, "two"), (3, 7, "three"), (4, 15, "many")]
    log.apply(len(batches), lambda tx: handle(tx, spark.createDataFrame([(k, 20 + k, AT(0), AT(25.5), "day") for k in range(5, 25)], EVENT)))
    assert [r[0] for r in held(log)] == [1, 3, 4, *range(5, 25)]
    now = log.read("latest").agg(F.max("received")).first()[0]
    assert {r.user_id for r in H.fresh(log.read("latest"), now, 20).collect()} == set(range(4, 25))
    log.vacuum(1)
    assert len(log.numbers()) == 1 and len(held(log)) == 23


OFFER = "id string, sku string, storeId string, stockQty long, isInStock boolean, lastSyncedAt timestamp, extra int"
PATCH = "sku string, storeId string, seq long, stockQty long, isInStock boolean, facilityCode string"


def test_inventory_patches(spark):
    offers = [("a", "S1", "x", 5, True, AT(0), 1), ("b", "S1", "y", 5, True, AT(0), 1), ("c", "S2", "x", 5, True, AT(0), 1), ("d", None, "x", 5, True, AT(0), 1), ("e", "S3", None, None, None, None, 1)]
    patches = [
        ("S1", None, 2, 7, None, "F"), ("S1", "x", 1, 3, False, None), ("S1", "y", 3, 0, False, None), ("S1", "z", 9, 1, None, None),
        ("S2", "x", 4, 5, True, None), (None, "x", 5, 1, False, None), ("S3", "x", 6, 1, None, None), ("S3", None, 7, None, True, None), ("S3", None, 7, None, True, None),
    ]
    o, p = spark.createDataFrame(offers, OFFER), spark.createDataFrame(patches, PATCH)
    found = {r.id: (r.stockQty, r.isInStock, r.facilityCode, r.matched, r.modified, r.extra) for r in N.patch_inventory(o, p).collect()}
    assert found == {
        "a": (7, False, "F", True, True, 1), "b": (0, False, "F", True, True, 1), "c": (5, True, None, True, False, 1),
        "d": (5, True, None, False, False, 1), "e": (None, True, None, True, True, 1),
    }
    variants = spark.createDataFrame([("p1", "x", "S1"), ("p1", "x", "S1"), ("p2", "y", "S1"), ("p3", "x", None)], "productId string, storeId string, sku string")
    told = {(r.seq, r.offersMatched, r.productsMatched) for r in N.inventory_matches(p, o, variants).collect()}
    assert told == {(2, 2, 2), (1, 1, 1), (3, 1, 1), (9, 0, 0), (4, 1, 0), (5, 0, 0), (6, 0, 0), (7, 1, 0)}
    assert N.patch_inventory(o, p.limit(0)).where("matched or modified").count() == 0 and N.patch_inventory(o.limit(0), p).count() == 0

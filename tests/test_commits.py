"""The commit log: batches are there whole or not at all, whenever the stream is stopped."""

import pytest
from pyspark.sql import functions as F

from shelfmark.plans import live_queries as L
from shelfmark.streaming import handlers as H
from shelfmark.streaming.commits import CommitLog

SF = "/root/testdata/sf0.001"
EVENT = "event_id long, topic string, ts timestamp, user_id long, value double"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Events in three files, a batch each; keys repeat within and across them."""
    folder = tmp_path_factory.mktemp("events")
    rows = [(i, ["create", "update", "inventory", "delete"][i % 4], f"2024-01-01 00:{i % 60:02d}:00", i * 7 % 23, i * 1.37 % 90) for i in range(180)]
    events = spark.createDataFrame(rows, EVENT.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
    for n in range(3):
        events.where(F.floor(F.col("event_id") / 60) == n).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def change(tx, batch):
    H.product_events(tx, L.product_payloads(batch))
    H.inventory_events(tx, L.stock_changes(batch))
    H.delete_events(tx, L.deletions(batch))


def log_of(spark, folder, tables):
    log = CommitLog(spark, f"file://{folder}", H.KEYS, 4)
    log.begin(tables)
    return log


def run(spark, log, landed, folder, handler=change):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(landed)
    H.run(stream, log, handler, f"file://{folder}/checkpoint")


def contents(log):
    return {name: sorted(map(str, (r.asDict() for r in log.read(name).collect()))) for name in H.KEYS}


@pytest.fixture(scope="module")
def tables(spark):
    return L.initial(spark, SF)


@pytest.fixture(scope="module")
def undisturbed(spark, landed, tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    log = log_of(spark, folder, tables)
    run(spark, log, landed, folder)
    assert log.numbers() == [0, 1, 2, 3]
    return contents(log)


class Stopped(Exception):
    pass


@pytest.mark.parametrize("after", ["products", "offers"])
def test_a_stop_between_two_tables(spark, landed, tables, undisturbed, tmp_path, after):
    log = log_of(spark, tmp_path, tables)

    def stopped(tx, batch):
        if len(log.numbers()) == 2:  # the second batch
            write = tx.write

            def once(name, rows, buckets):
                write(name, rows, buckets)
                if name == after:
                    raise Stopped(name)

            tx.write = once
        change(tx, batch)

    with pytest.raises(Exception, match="Stopped"):
        run(spark, log, landed, tmp_path, stopped)
    assert log.numbers() == [0, 1]
    before = contents(log)
    again = CommitLog(spark, log.folder, H.KEYS, 4)  # another driver
    again.begin(tables)
    assert contents(again) == before
    run(spark, again, landed, tmp_path)
    assert contents(again) == undisturbed and again.numbers() == [0, 1, 2, 3]
    run(spark, again, landed, tmp_path)  # nothing new has landed
    assert again.numbers() == [0, 1, 2, 3]


def test_a_batch_that_was_committed_is_not_applied_again(spark, tables, tmp_path):
    log = log_of(spark, tmp_path, tables)
    gone = lambda tx: tx.change("products", log.read("products").limit(5), lambda now, new: now.join(new, H.KEY, "left_anti").select(now.columns))
    assert log.apply(0, gone) and log.numbers() == [0, 1]
    held = contents(log)
    assert not log.apply(0, gone) and contents(log) == held
    assert len(held["products"]) == len(contents_of(log, "products", 0)) - 5
    kept = {b: p for b, p in log.manifest(0)["products"]["buckets"].items() if log.manifest(1)["products"]["buckets"][b] == p}
    assert kept or len({*log.manifest(0)["products"]["buckets"]}) <= 5  # buckets without changes keep their files
    log.apply(1, lambda tx: tx.change("products", log.read("products").limit(0), lambda now, new: now))  # nothing to do
    log.vacuum(1)
    assert log.numbers() == [2] and contents(log) == held


def contents_of(log, name, number):
    return log.read(name, number).collect()

"""Batches of long pages are bounded by bytes, and are not held as Python text as a whole."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from shelfmark.functions import html as H


def test_a_few_pages_are_held_at_a_time():
    pages = pa.array(["<p>" + "x" * 500_000 + "</p>", None, ""] * 60)
    tracemalloc.start()
    found = H._results(pages, lambda page: page.upper(), pa.string())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6  # 60 MB when all were read and kept
    assert found.to_pylist() == [None if p is None else p.upper() for p in pages.to_pylist()]


def test_batches_are_light(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        H.cleaned(F.lit("<p>a</p>"))
        assert int(spark.conf.get(name)) <= 8 << 20
    finally:
        spark.conf.set(name, before)

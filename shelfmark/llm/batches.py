"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shelfmark.sources.shared import light_batches  # noqa: F401

#: Rows in an Arrow batch. Texts can be long, so a batch is kept small.
ROWS = 1000


def small_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """Lowers the rows per Arrow batch of the session, so that a batch of long texts fits a Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of ``rows`` at most."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def ddl(df: DataFrame, names: list[str]) -> str:
    """Columns of ``df`` as a schema string."""
    return ", ".join(f"`{n.replace('`', '``')}` {df.schema[n].dataType.simpleString()}" for n in names)


def quoted(names: list[str]) -> list[str]:
    return [f"`{n.replace('`', '``')}`" for n in names]


def keep_rows(docs: DataFrame, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of ``docs``, with all columns, for whose texts ``keep`` says true."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield batch.filter(pa.array(keep(batch.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

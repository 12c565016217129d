"""A commit log: several tables that a stream changes together, in the folder that all executors share.

Each batch writes new versions of the buckets it touches, of one table after the other, and at last a manifest that names
the files of every bucket of every table. The manifest is written under a temporary name and renamed, so a batch is there
whole or not at all: readers take the manifest with the largest number, and a batch that was stopped between two tables
leaves files that no manifest names. After a restart the stream hands over the same batch again; if its manifest is there
it was applied and is left out, else it is applied to the manifest before it. Files and manifests are reached through
Hadoop's file systems, as Spark's own are. A manifest has a line for each bucket of each table, whatever the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


class CommitLog:
    """``keys``: by table, the column whose hash tells the bucket of a row."""

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.buckets = spark, folder, keys, buckets
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{folder}/{name}")
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The commits that are there."""
        place = self._path("commits")
        names = [s.getPath().getName() for s in self._files.listStatus(place)] if self._files.exists(place) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, number: int) -> dict:
        source = self._files.open(self._path(f"commits/{number:012d}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def publish(self, number: int, manifest: dict) -> None:
        temporary, final = self._path(f"commits/.{uuid.uuid4().hex}.tmp"), self._path(f"commits/{number:012d}.json")
        out = self._files.create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._files.rename(temporary, final) and not self._files.exists(final):
            raise OSError(f"commit {number} could not be named")

    def begin(self, tables: dict[str, DataFrame]) -> None:
        """Commit 0: the tables before the stream's first batch. Nothing is done if there are commits."""
        if not self.numbers():
            change = Transaction(self, {name: {"schema": df.schema.json(), "buckets": {}} for name, df in tables.items()})
            for name, df in tables.items():
                change.write(name, df, range(self.buckets))
            self.publish(0, change.tables)

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table as of a commit, the last one by default."""
        number = self.numbers()[-1] if number is None else number
        return Transaction(self, self.manifest(number)).read(name)

    def apply(self, batch: int, change: Callable[[Transaction], None]) -> bool:
        """Commits what ``change`` does with a transaction as number ``batch`` + 1; false if that commit is there."""
        numbers = self.numbers()
        if batch + 1 in numbers:
            return False
        own = Transaction(self, self.manifest(max(n for n in numbers if n <= batch)))
        change(own)
        self.publish(batch + 1, own.tables)
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Removes all commits but the last ``keep`` and files that these don't name; not while a batch is applied."""
        kept = self.numbers()[-keep:]
        named = {path.split("/")[2] for n in kept for t in self.manifest(n).values() for path in t["buckets"].values() if path}
        for number in set(self.numbers()) - set(kept):
            self._files.delete(self._path(f"commits/{number:012d}.json"), False)
        self._files.delete(self._path("side"), True)
        for name in self.keys:
            place = self._path(f"data/{name}")
            for status in self._files.listStatus(place) if self._files.exists(place) else []:
                if status.getPath().getName() not in named:
                    self._files.delete(status.getPath(), True)


class Transaction:
    """The tables of a commit, and the versions that a batch makes of them."""

    def __init__(self, log: CommitLog, tables: dict):
        self.log, self.tables, self.side = log, json.loads(json.dumps(tables)), {}

    def bucketed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(self.log.keys[name]), F.lit(self.log.buckets)).cast("int"))

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The table as it stands in this transaction, or these buckets of it."""
        held, schema = self.tables[name]["buckets"], StructType.fromJson(json.loads(self.tables[name]["schema"]))
        paths = [p for b, p in held.items() if p and (buckets is None or int(b) in buckets)]
        if not paths:
            return self.log.spark.createDataFrame([], schema)
        return self.log.spark.read.schema(schema).parquet(*[f"{self.log.folder}/{p}" for p in paths])

    def write(self, name: str, rows: DataFrame, buckets) -> None:
        """New versions of ``buckets``, which hold just ``rows``."""
        place = f"data/{name}/{uuid.uuid4().hex}"
        columns = StructType.fromJson(json.loads(self.tables[name]["schema"])).names
        self.bucketed(name, rows.select(*columns)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.log.folder}/{place}")
        found = {s.getPath().getName() for s in self.log._files.listStatus(self.log._path(place))}
        self.tables[name]["buckets"] |= {str(b): f"{place}/_bucket={b}" if f"_bucket={b}" in found else None for b in buckets}

    def write_side(self, name: str, rows: DataFrame) -> None:
        """Keeps rows for later steps of this transaction; no commit names them."""
        self.side[name] = f"{self.log.folder}/side/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(self.side[name])

    def read_side(self, name: str) -> DataFrame:
        return self.log.spark.read.parquet(self.side[name])

    def change(self, name: str, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replaces the buckets that ``rows`` fall into by ``merge`` of what they hold and ``rows``."""
        touched = sorted(r[0] for r in self.bucketed(name, rows).select("_bucket").distinct().collect())  # BUCKETS at most
        if touched:
            self.write(name, merge(self.read(name, touched), rows), touched)

"""A store of rows by key that batches change at the cost of the buckets they touch.

Rows lie in buckets by a hash of their key. A batch reads the buckets of its keys, writes their new rows to a folder of
its own and then commits one small file: which folder holds which bucket, and which batches have been taken in. The
newest commit is the store. A job that dies at any point before it leaves the store as it was, and the batch is taken in
when it runs again; one that dies after it finds its batch already taken in. Folders that no commit names any more are
swept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.sources.commits import CommitLog, child_folders, delete_folder

#: Column of the bucket in a store's files; rows may not have one of that name.
BUCKET = "store_bucket"
#: Commits that stay in the log for readers that are at work; a sweep deletes older ones.
KEPT_COMMITS = 16


class BucketStore:
    """Rows by key in buckets below path. buckets counts for a new store; one that is there keeps its own number.

    Choose it so that a bucket is a few files of a good size: a batch costs the buckets that its keys fall into.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.log = CommitLog(spark, f"{path}/_log")

    def _rows(self, entry: dict, only: set[int] | None = None) -> DataFrame:
        """What a commit's buckets hold, or some of them."""
        schema = T.StructType.fromJson(entry["schema"])
        paths = [f"{self.path}/data/{folder}/{BUCKET}={b}" for b, folder in entry["at"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All rows; a store that nothing was committed to is refused."""
        entry = self.log.latest()[1]
        if entry is None:
            raise LookupError(f"nothing is stored in {self.path}")
        return self._rows(entry)

    def merge(self, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], source: str | None = None, number: int | None = None) -> list[int]:
        """Take a batch in: the rows of the buckets it touches become change(stored rows, batch). The touched buckets come back.

        change is given whole buckets, and has to leave rows of other keys as they are. A batch of a source whose number
        is not above the last one taken in from it changes nothing. Two writers that meet both get through, one after
        the other.
        """
        if BUCKET in batch.columns:
            raise ValueError(f"a column is called {BUCKET}")
        while True:
            last, entry = self.log.latest()
            taken = {} if entry is None else entry["taken"]
            if source is not None and number is not None and number <= taken.get(source, -1):
                return []
            n = self.buckets if entry is None else entry["buckets"]
            spread = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(n)).cast("int")
            touched = sorted(r[0] for r in batch.select(spread).distinct().collect())  # at most as many as there are buckets
            at = {} if entry is None else dict(entry["at"])
            schema = None if entry is None else T.StructType.fromJson(entry["schema"])
            if touched:
                stored = batch.limit(0) if entry is None else self._rows(entry, set(touched))
                rows = change(stored, batch)
                if schema is not None:
                    if sorted(rows.columns) != sorted(schema.names):
                        raise ValueError("the store has other columns")
                    rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])
                folder = uuid.uuid4().hex
                # a large bucket is written by several tasks, small ones share one
                rows.withColumn(BUCKET, spread).hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
                written = {name.removeprefix(f"{BUCKET}=") for name in child_folders(self.spark, f"{self.path}/data/{folder}")}
                at = {b: f for b, f in at.items() if int(b) not in touched} | {b: folder for b in written if b.isdigit()}
                schema = rows.schema if schema is None else schema
            if source is not None and number is not None:
                taken = taken | {source: number}
            schema = batch.schema if schema is None else schema
            if self.log.commit(last + 1, {"buckets": n, "at": at, "taken": taken, "schema": schema.jsonValue()}):
                return touched

    def sweep(self, older_than: datetime) -> int:
        """Delete folders that the last commits don't name and that were begun before a time, and older commits; how many folders went.

        The time spares batches that are on their way: choose it further back than any batch runs.
        """
        numbers = self.log.numbers()
        kept = numbers[-KEPT_COMMITS:]
        named = {f for n in kept for f in self.log.read(n)["at"].values()}
        strays = [f for f in child_folders(self.spark, f"{self.path}/data", older_than) if f not in named]
        for f in strays:
            delete_folder(self.spark, f"{self.path}/data/{f}")
        for n in numbers[: -KEPT_COMMITS]:
            self.log.delete(n)
        return len(strays)


def batch_source(batch: DataFrame) -> str:
    """The streaming query that hands out a batch, by the id that its checkpoint keeps; calls outside a stream share one name."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "calls"

"""Checked publication of partitioned, versioned tables in a folder.

A table is a folder of snapshots and a log of commits. A publication stages the typed rows, runs all checks in one pass,
writes the snapshot's files and commits last, under a version number that one writer alone can take: readers see whole
versions only, and a failed check or a lost job leaves the table as it was. Old versions expire by age; a sweep then
deletes every file that no version left needs, those of lost jobs too.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tracelake.sources.commits import CommitLog, delete_folder

#: One entry a commit. kind: overwrite and insert touch one partition, replace the whole table; expire ends all versions before its own floor.
_MANIFEST = "version long, kind string, partition string, folder string, rows long, columns string, at timestamp, floor long"


class CheckFailed(ValueError):
    """A check that did not pass, by name and count; it never carries row values."""


@dataclass(frozen=True)
class Table:
    """A published table: base folder, namespace and name; the same name under two bases is two tables."""

    base: str
    namespace: str
    name: str
    partition: tuple[str, ...] = ("ds",)
    schema: str | None = None
    not_null: tuple[str, ...] = ()
    checks: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...] = field(default=())

    @property
    def path(self) -> str:
        return f"{self.base}/{self.namespace}/{self.name}"

    def check_not_null(self, column: str) -> Table:
        return replace(self, not_null=(*self.not_null, column))

    def check(self, name: str, violations: Callable[[DataFrame], DataFrame]) -> Table:
        """A check passes if its function of the candidate rows gives no row."""
        if name in [n for n, _ in self.checks]:
            raise ValueError(f"two checks are named {name}")
        return replace(self, checks=(*self.checks, (name, violations)))


def _log(spark: SparkSession, table: Table) -> CommitLog:
    return CommitLog(spark, f"{table.path}/_log")


def manifest(spark: SparkSession, table: Table) -> DataFrame:
    """The commits of a table, one row each."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{table.path}/_log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def versions(spark: SparkSession, table: Table) -> DataFrame:
    """(version, at, rows): one row a version that can be read, with the rows that its commit wrote."""
    known = manifest(spark, table)
    floor = known.agg(F.coalesce(F.max("floor"), F.lit(0)).alias("f"))
    return known.where("kind <> 'expire'").join(F.broadcast(floor), F.col("version") >= F.col("f")).select("version", "at", "rows")


def _spans(spark: SparkSession, table: Table) -> DataFrame:
    """(version, until, folder, rows): from which version on, and before which, the files of a commit are part of the table.

    A later overwrite of its partition ends it, and so does a later replacement of the whole table. One row a commit.
    """
    m = manifest(spark, table).where("kind <> 'expire'")
    later = lambda kind, *by: F.min(F.when(F.col("kind") == kind, F.col("version"))).over(W.partitionBy(*by).orderBy("version").rowsBetween(1, W.unboundedFollowing))
    ends = F.least(F.when(F.col("kind") != "replace", later("overwrite", "partition")), later("replace", F.lit(0)))
    return m.select("version", ends.alias("until"), "folder", "rows").where("rows > 0")


def live_folders(spark: SparkSession, table: Table, version: int) -> DataFrame:
    """(folder, rows): what makes up one version."""
    return _spans(spark, table).where((F.col("version") <= version) & (F.col("until").isNull() | (F.col("until") > version))).select("folder", "rows")


def read_version(spark: SparkSession, table: Table, version: int | None = None) -> DataFrame:
    """A version of a table, the newest if none is named; one that was never committed, or has expired, is refused."""
    known = versions(spark, table)
    if version is not None:
        known = known.where(F.col("version") == version)
    wanted = known.agg(F.max("version")).first()[0]
    if wanted is None:
        raise LookupError(f"{table.namespace}.{table.name} has no version {'' if version is None else version} to read".replace("  ", " "))
    schema = T._parse_datatype_string(_log(spark, table).read(wanted)["columns"])
    folders = [r["folder"] for r in live_folders(spark, table, wanted).select("folder").collect()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def staged(df: DataFrame, table: Table, partition: dict[str, str]) -> DataFrame:
    """df in the table's shape: declared columns cast by name, extras left out, partition columns as given."""
    if set(partition) != set(table.partition):
        raise ValueError(f"the partition columns are {table.partition}")
    if table.schema is not None:
        want = T._parse_datatype_string(table.schema)
        missing = [f.name for f in want.fields if f.name not in df.columns and f.name not in partition]
        if missing:
            raise ValueError(f"columns {missing} are missing")
        cols = [F.lit(partition[f.name]).cast(f.dataType).alias(f.name) if f.name in partition else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want.fields]
        return df.select(*cols)
    own = [c for c in df.columns if c not in partition]
    return df.select(*[F.col(f"`{c}`") for c in own], *[F.lit(v).cast("string").alias(k) for k, v in partition.items()])


def publish(df: DataFrame, table: Table, partition: dict[str, str], mode: str = "overwrite", at: datetime | None = None) -> dict:
    """Publish df as a partition (overwrite), as more of it (insert) or as the whole table (replace); the receipt is returned.

    Columns are matched by name. An empty result clears its partition. Modes by key are refused.
    """
    if mode not in ("overwrite", "insert", "replace"):
        raise ValueError(f"no mode {mode}")
    spark = df.sparkSession
    rows = staged(df, table, partition)
    folder = f"{table.path}/data/{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(f"{folder}/stage")
    stage = spark.read.schema(rows.schema).parquet(f"{folder}/stage")
    counts = stage.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in table.not_null]).first()
    for c in table.not_null:
        if counts[c]:
            raise CheckFailed(f"{c} is null in {counts[c]} rows")
    for name, violations in table.checks:
        n = violations(stage).count()
        if n:
            raise CheckFailed(f"{name}: {n} violations")
    log = _log(spark, table)
    number = log.latest()[0] + 1
    while True:
        # what another writer has committed meanwhile is looked at again before each try
        columns, at_folder = _fitted(spark, log, number, stage, rows.schema, folder, mode)
        entry = {
            "version": number, "kind": mode, "partition": None if mode == "replace" else json.dumps(partition, sort_keys=True), "folder": at_folder, "rows": counts["_n"],
            "columns": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields), "at": _stamp(at),
        }
        if log.commit(number, entry):
            return {"namespace": table.namespace, "table": table.name, "version": number, "rows": counts["_n"], "columns": len(columns.fields)}
        number = max(number, log.latest()[0]) + 1


def _fitted(spark: SparkSession, log: CommitLog, number: int, stage: DataFrame, schema: T.StructType, folder: str, mode: str) -> tuple[T.StructType, str]:
    """The columns that a commit of staged rows has, in the order of the table before it, and the folder that holds them so."""
    before = [n for n in log.numbers() if n < number]
    if mode == "replace" or not before:
        return schema, f"{folder}/stage"
    have = T._parse_datatype_string(log.read(before[-1])["columns"])
    if sorted(f.name for f in have.fields) != sorted(schema.names):
        raise ValueError("the table has other columns; replace it")
    typed = stage.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in have.fields])
    if typed.schema.simpleString() == schema.simpleString():
        return have, f"{folder}/stage"
    at = f"{folder}/typed-{number}"
    typed.write.option("compression", "zstd").parquet(at)
    return have, at


def has_table(spark: SparkSession, table: Table) -> bool:
    return not manifest(spark, table).isEmpty()


def has_partition(spark: SparkSession, table: Table, partition: dict[str, str]) -> bool:
    """Whether a partition of one or more keys has landed with rows."""
    if not has_table(spark, table):
        return False
    df = read_version(spark, table)
    for k, v in partition.items():
        df = df.where(F.col(k).cast("string").eqNullSafe(F.lit(v)))
    return not df.limit(1).isEmpty()


def latest_partition(spark: SparkSession, table: Table, key: str = "ds") -> str:
    """The greatest value of a partition key; a table without rows is refused."""
    found = read_version(spark, table).agg(F.max(F.col(key).cast("string"))).first()[0]
    if found is None:
        raise LookupError(f"{table.namespace}.{table.name} is empty")
    return found


def _utc(at: datetime) -> datetime:
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def _stamp(at: datetime | None) -> str:
    """A time as it is committed; now, if none is given. Times without a zone are in UTC."""
    return _utc(at or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def expire(spark: SparkSession, table: Table, older_than: datetime) -> list[int]:
    """End the versions that were committed before a time, but never the newest; their numbers come back.

    An expired version can't be read from then on. Files stay until they are swept.
    """
    known = versions(spark, table)
    newest = known.agg(F.max("version")).first()[0]
    if newest is None:
        return []
    # a version is kept with all that follow it: a later one may have an earlier time where clocks differ
    kept = known.where((F.col("at") >= F.lit(_utc(older_than))) | (F.col("version") == newest)).agg(F.min("version")).first()[0]
    gone = [r["version"] for r in known.where(F.col("version") < kept).orderBy("version").collect()]
    log = _log(spark, table)
    while gone:  # another writer may take the number
        number = log.latest()[0] + 1
        if log.commit(number, {"version": number, "kind": "expire", "floor": kept, "columns": log.read(number - 1)["columns"], "at": _stamp(None)}):
            break
    return gone


def stray_files(spark: SparkSession, table: Table, older_than: datetime) -> DataFrame:
    """(path, length, modified, folder) of the data files that no version left needs and that were written before a time.

    The time spares publications that are still on their way: choose it further back than any job runs. Files are listed
    by Spark, which does so on the executors where there are many folders, and never opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{table.path}/data").select("path", "length", F.col("modificationTime").alias("modified"))
    files = files.withColumn("folder", F.regexp_extract("path", r"/data/([0-9a-f]{32}/[^/]+)/[^/]*$", 1))
    first = versions(spark, table).agg(F.min("version").alias("first"))
    spans = _spans(spark, table).join(F.broadcast(first), F.col("until").isNull() | (F.col("until") > F.col("first")))
    needed = spans.select(F.regexp_extract("folder", r"/data/([0-9a-f]{32}/[^/]+)$", 1).alias("folder"))
    return files.join(needed, "folder", "left_anti").where(F.col("modified") < F.lit(_utc(older_than))).select("path", "length", "modified", "folder")


def sweep(spark: SparkSession, table: Table, older_than: datetime) -> dict:
    """Delete the stray files of a table, folder by folder; {folders, files, bytes} comes back.

    Expired versions lose their files by it, and so do publications that failed. A sweep that is cut short leaves strays
    to the next one.
    """
    found = {"folders": 0, "files": 0, "bytes": 0}
    strays = stray_files(spark, table, older_than).groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    for r in strays.toLocalIterator():
        delete_folder(spark, f"{table.path}/data/{r['folder']}")
        found = {"folders": found["folders"] + 1, "files": found["files"] + r["files"], "bytes": found["bytes"] + r["bytes"]}
    return found


@dataclass(frozen=True)
class RunContext:
    """Run date, environment and named parameters of a job; outside production tables get a test_ prefix."""

    ds: str
    prod: bool = False
    params: tuple[tuple[str, str], ...] = ()

    def table(self, name: str) -> str:
        return name if self.prod else f"test_{name}"

    def sql(self, spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
        """A query with :ds and the named parameters; tables come as {name}."""
        return spark.sql(text, args={"ds": self.ds, **dict(self.params)}, **tables)


def land(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Hive-partitioned Parquet, zstd; partitions in df are overwritten, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)

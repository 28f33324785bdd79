"""Session helpers shared by every job of the library."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session in UTC with adaptive execution on; clusters bring their own session instead."""
    return (
        SparkSession.builder.master(master)
        .appName("tracelake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows that Python workers are handed at once where the session leaves Spark's default of 10,000: whole texts are large.
ARROW_ROWS = 1000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def share_code(spark: SparkSession) -> None:
    """Prepare Python workers: let those that see the driver's folders import this library (other clusters need it installed or sent with --py-files), and hand them whole texts in small batches."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{env.get('PYTHONPATH', '')}".rstrip(":")
    if spark.conf.get(_ARROW, "10000") == "10000":
        spark.conf.set(_ARROW, ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; only where it is unset, and the master local, take a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracelake-ck-", dir="/tmp"))


def free_names(df: DataFrame, n: int) -> list[str]:
    """So many column names that df, whatever its columns are called, does not have."""
    taken, i = {c.lower() for c in df.columns}, 0
    out: list[str] = []
    while len(out) < n:
        if f"_own{i}" not in taken:
            out.append(f"_own{i}")
        i += 1
    return out


#: Whether the shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint; survives lost executors. What df was shuffled through is deleted once it is written."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        # a query of its own: the setting holds for those made under it
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(_CLEANUP, before)


_GUESSED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def measured(spark: SparkSession) -> Iterator[None]:
    """Joins that run within it broadcast a side only if what was shuffled of it was measured as small. Guesses take an exploded row as one and an array as one item, so that a guess within the limit can be a table beyond the driver's memory."""
    guessed, known = spark.conf.get(_GUESSED), spark.conf.get(_MEASURED, None)
    spark.conf.set(_MEASURED, known or guessed)
    spark.conf.set(_GUESSED, "-1")
    try:
        yield
    finally:
        spark.conf.set(_GUESSED, guessed)
        if known:
            spark.conf.set(_MEASURED, known)
        else:
            spark.conf.unset(_MEASURED)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def parts_of(df: DataFrame, rows: int = 1 << 17) -> int:
    """Partitions for so many rows of df each, which are counted: dealt into them, what a task sorts does not grow with df."""
    return -(-df.count() // rows) or 1

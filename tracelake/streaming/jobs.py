"""Structured Streaming twins of the incremental jobs. Each gives what its batch form gives over the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tracelake.operators.activity import mark_repeats
from tracelake.operators.relational import newest_per_key
from tracelake.operators.rules import Rule, verdict_columns
from tracelake.sources.commits import child_folders, delete_folder
from tracelake.streaming.store import BucketStore, batch_source


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """Parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now as Parquet and stop; a restart goes on from the checkpoint."""
    return df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def each_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rewrite_sessions(path: str, key: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A batch function that adds the rows it sees to the sessions of their keys; equal rows stay as many as they are.

    The buckets of the keys are rewritten, no others. A batch that runs twice is taken in once.
    """

    def run(batch: DataFrame, number: int) -> None:
        BucketStore(batch.sparkSession, path, [key], buckets).merge(batch, lambda old, new: old.unionByName(new), batch_source(batch), number)

    return run


def upsert(path: str, keys: Sequence[str], version: Sequence[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the newest row of every key; safe to run twice on one batch, or by a new stream over a store."""

    def run(batch: DataFrame, number: int) -> None:
        BucketStore(batch.sparkSession, path, keys, buckets).merge(batch, lambda old, new: newest_per_key(old.unionByName(new), keys, version))

    return run


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """What the batches of rewrite_sessions, upsert or refresh_blocks have stored."""
    return BucketStore(spark, path, []).read()


def first_copies(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each id once, as long as its copies come within the lateness."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def paired(calls: DataFrame, results: DataFrame, key: str, ts: str, late: str, within: str) -> DataFrame:
    """Calls with their results, or without after the time allowed; state is bounded by both watermarks."""
    c = calls.withWatermark(ts, late).select(F.col(key).alias("call_key"), F.col(ts).alias("called_at"), *[x for x in calls.columns if x not in (key, ts)])
    r = results.withWatermark(ts, late).select(F.col(key).alias("result_key"), F.col(ts).alias("returned_at"))
    cond = (F.col("call_key") == F.col("result_key")) & F.col("returned_at").between(F.col("called_at"), F.col("called_at") + F.expr(f"interval {within}"))
    return c.join(r, cond, "left_outer")


def live_windows(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions by a gap of silence: (key, started, ended, n)."""
    t = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return t.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


class _LastSeen(StatefulProcessor):
    """Of a bucket of keys the stretches of activity that may still grow; one that has been silent for gap seconds of event time is sent and forgotten.

    A bucket's stretches are one value, an Arrow table, so that calls of the state store grow with buckets, not with keys.
    """

    def __init__(self, gap_s: int) -> None:
        self._gap = gap_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("stretches", "held binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [self._held()]
        for pdf in rows:
            seen = pdf[pdf["ts"].notna()]
            at = seen["ts"].to_numpy("datetime64[us]").astype("int64")
            parts.append(pd.DataFrame({"key": seen["key"].to_numpy(object), "started": at, "seen": at, "n": np.ones(len(at), np.int64)}))
        self._keep(_merged(pd.concat([p for p in parts if len(p)] or parts[:1]), self._gap))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        over = _ms(held["seen"] + self._gap) <= timerValues.getCurrentWatermarkInMs()
        self._keep(held[~over])
        if over.any():
            gone = held[over]
            yield pd.DataFrame({"key": gone["key"], "started": gone["started"].astype("datetime64[us]"), "last_seen": gone["seen"].astype("datetime64[us]"), "n": gone["n"]})

    def _held(self) -> pd.DataFrame:
        value = self._open.get()
        if value is None:
            return pd.DataFrame({"key": np.zeros(0, object), **{c: np.zeros(0, np.int64) for c in ("started", "seen", "n")}})
        t = pa.ipc.open_stream(bytes(value[0])).read_all()
        return pd.DataFrame({"key": np.array(t["key"].to_pylist(), object), **{c: t[c].to_numpy() for c in ("started", "seen", "n")}})

    def _keep(self, held: pd.DataFrame) -> None:
        for timer in self._handle.listTimers():
            self._handle.deleteTimer(timer)
        if not len(held):
            self._open.clear()
            return
        made = pa.record_batch({"key": pa.array(held["key"].to_numpy(object), pa.string(), from_pandas=True), **{c: pa.array(held[c].to_numpy()) for c in ("started", "seen", "n")}})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, made.schema) as out:
            out.write_batch(made)
        self._open.update((sink.getvalue().to_pybytes(),))
        self._handle.registerTimer(int(_ms(held["seen"].min() + self._gap)))

    def close(self) -> None:
        pass


def _merged(held: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Stretches of keys (null is one) in any order, with those joined that lie less than gap microseconds apart."""
    if not len(held):
        return held
    code = pd.factorize(held["key"])[0]
    order = np.lexsort((held["started"].to_numpy(), code))
    code, held = code[order], held.iloc[order]
    seen = held["seen"].groupby(code).cummax().to_numpy()
    first = np.append(0, 1 + np.flatnonzero((code[1:] != code[:-1]) | (held["started"].to_numpy()[1:] - seen[:-1] >= gap)))
    last = np.append(first[1:], len(held)) - 1
    return pd.DataFrame({"key": held["key"].to_numpy(object)[first], "started": held["started"].to_numpy()[first], "seen": seen[last], "n": np.add.reduceat(held["n"].to_numpy(), first)})


def _ms(us):
    """Milliseconds of microseconds, up: a timer must not go off before its time."""
    return -(-us // 1000)


def idle_sessions(stream: DataFrame, key: str, ts: str, gap_seconds: int, late: str, buckets: int = 256) -> DataFrame:
    """(key, started, last_seen, n): a key's stretch of activity, once it has been silent for so long.

    Last-seen state with a timer, for buckets of keys by their hash: a stretch is sent when the watermark passes its last
    row by the gap, and its state goes with it, so that state holds what was active within the gap and the lateness. A
    batch reads and writes the buckets that its keys fall into; one bucket's state is held in memory at a time, so that
    buckets should grow with the keys (256 for some millions of open stretches), and stay as they are for a checkpoint.
    Rows may come in any order within the lateness; a row without a time tells nothing; a null key is a key, of a type
    whose text can be cast back. The same stretches as a batch finds. Needs the state store of RocksDB
    (spark.sql.streaming.stateStore.providerClass).
    """
    kind = stream.schema[key].dataType
    if not isinstance(kind, T.AtomicType):
        raise ValueError(f"{key} is of type {kind.simpleString()}; its text can't be cast back")
    slim = stream.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    sent = slim.groupBy("bucket").transformWithStateInPandas(_LastSeen(gap_seconds), "key string, started timestamp, last_seen timestamp, n bigint", "Append", "EventTime")
    return sent.select(F.col("key").cast(kind).alias(key), "started", "last_seen", "n")


#: The state store that keyed state with timers asks for.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed_counts(stream: DataFrame, ts: str, kind: str, size: str, slide: str | None, late: str | None) -> DataFrame:
    """(started, kind, n) by tumbling or sliding windows; the same call serves a table."""
    t = stream.withWatermark(ts, late) if late else stream
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return t.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), kind, "n")


#: Partition columns of landed telemetry: the day of a row, and the stream and batch that brought it.
DAY, BROUGHT = "ds", "brought_by"


def land_batch(out: str, kind: str, ts: str) -> Callable[[DataFrame, int], None]:
    """A batch function that lands rows by day, batch and signal; a batch that is run again replaces what it wrote before.

    A day lies in one folder, so that expire_days takes it away at once. Rows without a time lie in a folder that does
    not expire. Rows may not have columns called as DAY or BROUGHT.
    """

    def run(batch: DataFrame, number: int) -> None:
        if {DAY, BROUGHT} & {c.lower() for c in batch.columns}:
            raise ValueError(f"a column is called {DAY} or {BROUGHT}")
        rows = batch.withColumns({DAY: F.date_format(ts, "yyyy-MM-dd"), BROUGHT: F.lit(f"{batch_source(batch)}-{number}")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, BROUGHT, kind).parquet(out)

    return run


def land_signals(stream: DataFrame, out: str, checkpoint: str, kind: str, ts: str, every: str = "5 seconds", once: bool = True) -> StreamingQuery:
    """Telemetry rows to Parquet by day and signal, every few seconds, or once over what is there. Cases as in land_batch."""
    w = stream.writeStream.foreachBatch(land_batch(out, kind, ts)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def read_signals(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """What has landed, with the day of each row; schema is that of the rows. Nothing landed gives no rows."""
    if not child_folders(spark, out):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(DAY, T.StringType())]))
    stored = T.StructType([*schema.fields, T.StructField(DAY, T.StringType()), T.StructField(BROUGHT, T.StringType())])
    return spark.read.schema(stored).parquet(out).select(*[F.col(f"`{c}`") for c in schema.names], DAY)


def expire_days(spark: SparkSession, out: str, before: date) -> list[str]:
    """Delete the days before a date with all that landed for them; the days that went, in order.

    One deletion a day, however much it holds. A row that comes late for such a day lands again and goes at the next
    call; a query that is reading a day while it goes fails and has to be run again. Run again after a failure it goes on.
    """
    days = [name.removeprefix(f"{DAY}=") for name in child_folders(spark, out)]
    gone = sorted(d for d in days if re.fullmatch(r"\d{4}-\d\d-\d\d", d) and d < before.isoformat())
    for d in gone:
        delete_folder(spark, f"{out}/{DAY}={d}")
    return gone


def stream_verdicts(stream: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """Verdicts on arriving rows: a map without state or shuffle."""
    return verdict_columns(stream, rules, keys)


def refresh_blocks(path: str, file: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A batch function that replaces the rows of the files it sees; a batch may run twice.

    Batches are expected to hold a changed file whole.
    """

    def run(batch: DataFrame, number: int) -> None:
        replace = lambda old, new: old.join(new.select(file).distinct(), file, "left_anti").unionByName(new)
        BucketStore(batch.sparkSession, path, [file], buckets).merge(batch, replace)

    return run


def read_blocks(spark: SparkSession, path: str, id_col: str, order: Sequence[str]) -> DataFrame:
    """The rows that refresh_blocks has stored, with repeats marked: whether a row is the first of its id may change with any other file, so it is told when rows are read."""
    return mark_repeats(read_store(spark, path), id_col, order)


def files_to_refresh(listing: DataFrame, stored: DataFrame, file: str, modified: str, since: Column, overlap: Column) -> DataFrame:
    """Files of a listing that changed since the last refresh less an overlap, or that are not stored yet."""
    known = stored.select(file).distinct().withColumn("_known", F.lit(True))
    return listing.join(known, file, "left").where((F.col(modified) >= since - overlap) | F.col("_known").isNull()).select(*listing.columns)


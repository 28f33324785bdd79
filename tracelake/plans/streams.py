"""Queries of the streaming family: each lands the events as files, streams them and returns what the stream wrote."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.rules import Rule
from tracelake.session import cut, ensure_checkpoint_dir, scratch, table
from tracelake.streaming import jobs as J

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _landed(spark: SparkSession, d: str, rows: DataFrame | None = None, batches: int = 3, by: str = "ts") -> tuple[DataFrame, str]:
    """Events written as files in order of time, and a stream over them in a few batches."""
    base = scratch(spark, "stream")
    e = (table(spark, d, "events") if rows is None else rows).withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(batches, by).sortWithinPartitions("ts").write.parquet(f"{base}/in")
    return J.read_stream(spark, f"{base}/in", e.schema, max_files=1), base


def _close(spark: SparkSession, d: str, s: DataFrame, base: str, *rows: dict) -> None:
    """Write rows of a far later time behind a stream: they close every window, so that the stream's result is whole."""
    last = table(spark, d, "events").agg(F.max("ts").cast("timestamp").alias("ts"))
    for row in rows:
        made = last.select((F.col("ts") + F.expr("interval 90 days")).alias("ts"))
        made.select(*[F.col("ts") if c == "ts" else F.lit(row.get(c)).cast(s.schema[c].dataType).alias(c) for c in s.columns]).write.mode("append").parquet(f"{base}/in")


@query("SELECT event_id, user_id FROM events")
def l1_session_store(spark: SparkSession, d: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    s, base = _landed(spark, d)
    J.each_batch(s.select("event_id", "user_id"), J.rewrite_sessions(f"{base}/store", "user_id"), f"{base}/ck").awaitTermination()
    return J.read_store(spark, f"{base}/store")


@query("SELECT event_id, event_id > min(event_id) OVER (PARTITION BY user_id, event_type, props) AS is_repeat FROM events")
def l2_block_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Files of a hundred events; ids are user, type and props, so that many repeat."""
    e = table(spark, d, "events")
    rows = e.select("event_id", "ts", F.expr("event_id div 100").alias("file"), F.concat_ws("|", "user_id", "event_type", "props").alias("id"))
    s, base = _landed(spark, d, rows, by="file")
    J.each_batch(s, J.refresh_blocks(f"{base}/blocks", "file"), f"{base}/ck").awaitTermination()
    return J.read_blocks(spark, f"{base}/blocks", "id", ["event_id"]).select("event_id", "is_repeat")


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def l3_newest_wins(spark: SparkSession, d: str) -> DataFrame:
    s, base = _landed(spark, d)
    J.each_batch(s.select("user_id", "event_id", "ts"), J.upsert(f"{base}/new", ["user_id"], ["ts", "event_id"]), f"{base}/ck").awaitTermination()
    return J.read_store(spark, f"{base}/new")


@query("SELECT event_id, user_id FROM events")
def l4_first_copies(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    s, base = _landed(spark, d, e.union(e.where("event_id % 4 = 0")))
    J.run_available(J.first_copies(s, "event_id", "ts", "40 days").select("event_id", "user_id"), f"{base}/out", f"{base}/ck").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("""SELECT c.event_id AS call_key, r.returned_at FROM (SELECT event_id, ts FROM events WHERE event_type = 'click') c LEFT JOIN (SELECT event_id - 1 AS k, ts AS returned_at FROM events WHERE event_type = 'view') r ON r.k = c.event_id AND r.returned_at BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR""")
def l5_paired(spark: SparkSession, d: str) -> DataFrame:
    s, base = _landed(spark, d)
    _close(spark, d, s, base, {"event_id": -10, "event_type": "click"}, {"event_id": -20, "event_type": "view"})
    calls = s.where("event_type = 'click'").select(F.col("event_id").alias("k"), "ts")
    results = s.where("event_type = 'view'").select((F.col("event_id") - 1).alias("k"), "ts")
    J.run_available(J.paired(calls, results, "k", "ts", "40 days", "1 hour").select("call_key", "returned_at"), f"{base}/out", f"{base}/ck").awaitTermination()
    return spark.read.schema("call_key long, returned_at timestamp").parquet(f"{base}/out").where("call_key >= 0")


_SESSIONS = """WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM f), w AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 12 HOUR AS ended, count(*) AS n FROM g GROUP BY user_id, i) """


@query(_SESSIONS + "SELECT * FROM w")
def l6_live_windows(spark: SparkSession, d: str) -> DataFrame:
    s, base = _landed(spark, d)
    _close(spark, d, s, base, {"user_id": -1})
    J.run_available(J.live_windows(s, "user_id", "ts", "12 hours", "40 days"), f"{base}/out", f"{base}/ck").awaitTermination()
    return spark.read.parquet(f"{base}/out").where("user_id >= 0")


@query(_SESSIONS + "SELECT user_id, started, ended - INTERVAL 12 HOUR AS last_seen, n FROM w")
def l6_idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The same sessions from state by key: each is sent by a timer once it has been idle for twelve hours."""
    s, base = _landed(spark, d)
    _close(spark, d, s, base, {"user_id": -1})
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    try:
        J.run_available(J.idle_sessions(s, "user_id", "ts", 12 * 3600, "40 days"), f"{base}/out", f"{base}/ck").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{base}/out").where("user_id >= 0")


def _windows_of(spark: SparkSession, d: str, size: str, slide: str | None) -> DataFrame:
    """Windows of a stream with a watermark, each written once, when it is closed."""
    s, base = _landed(spark, d)
    _close(spark, d, s, base, {})
    J.run_available(J.windowed_counts(s, "ts", "event_type", size, slide, "40 days"), f"{base}/out", f"{base}/ck").awaitTermination()
    return spark.read.parquet(f"{base}/out").where("event_type is not null")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL")
def l7_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    return _windows_of(spark, d, "1 hour", None)


@query("SELECT started, event_type, count(*) AS n FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 23 HOUR, time_bucket(INTERVAL 1 HOUR, ts), INTERVAL 1 HOUR)) AS started, event_type FROM events) GROUP BY ALL")
def l7_sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return _windows_of(spark, d, "1 day", "1 hour")


@query("SELECT event_type, ts::DATE::VARCHAR AS ds, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL")
def l8_land_signals(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and signal, of which the days before the tenth are deleted."""
    s, base = _landed(spark, d)
    J.land_signals(s, f"{base}/out", f"{base}/ck", "event_type", "ts").awaitTermination()
    J.expire_days(spark, f"{base}/out", date(2024, 1, 10))
    return J.read_signals(spark, f"{base}/out", s.schema).groupBy("event_type", "ds").agg(F.count("*").alias("n"))


@query("SELECT ts::DATE::VARCHAR AS ds, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1")
def l8_expired_days(spark: SparkSession, d: str) -> DataFrame:
    """The days that a retention of telemetry takes away, with the rows that go."""
    s, base = _landed(spark, d)
    J.land_signals(s, f"{base}/out", f"{base}/ck", "event_type", "ts").awaitTermination()
    landed = cut(J.read_signals(spark, f"{base}/out", s.schema).groupBy("ds").agg(F.count("*").alias("n")))
    gone = spark.createDataFrame([(x,) for x in J.expire_days(spark, f"{base}/out", date(2024, 1, 10))], "ds string")
    return landed.join(gone, "ds")


@query("SELECT event_type AS signal, count(*) AS n, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def k11_telemetry(spark: SparkSession, d: str) -> DataFrame:
    """Signals told apart by kind land in folders of their own within a day's."""
    s, base = _landed(spark, d)
    J.land_signals(s, f"{base}/otlp", f"{base}/ck", "event_type", "ts").awaitTermination()
    return J.read_signals(spark, f"{base}/otlp", s.schema).groupBy(F.col("event_type").alias("signal")).agg(F.count("*").alias("n"), F.countDistinct("ds").alias("days"))


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01 05:00:00')")
def l9_refetch(spark: SparkSession, d: str) -> DataFrame:
    from tracelake.operators.relational import due

    s, base = _landed(spark, d)
    J.run_available(s.select(F.col("event_id").alias("page_id"), "ts"), f"{base}/log", f"{base}/ck").awaitTermination()
    return due(table(spark, d, "pages").select("page_id"), spark.read.parquet(f"{base}/log"), "page_id", "ts", F.lit("2024-01-01 05:00:00").cast("timestamp"))


_RULES = [Rule("big", "value > 100", "deny"), Rule("error", "event_type = 'error'", "ask"), Rule("odd", "event_id % 2 = 1")]


@query("""SELECT event_id, CASE WHEN value > 100 THEN 'deny' WHEN event_type = 'error' THEN 'ask' ELSE 'context' END AS verdict, concat_ws(',', CASE WHEN value > 100 THEN 'big' END, CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN event_id % 2 = 1 THEN 'odd' END) AS reasons FROM events WHERE value > 100 OR event_type = 'error' OR event_id % 2 = 1""")
def l10_stream_verdicts(spark: SparkSession, d: str) -> DataFrame:
    s, base = _landed(spark, d)
    J.run_available(J.stream_verdicts(s, _RULES, ["event_id"]), f"{base}/out", f"{base}/ck").awaitTermination()
    return spark.read.parquet(f"{base}/out")

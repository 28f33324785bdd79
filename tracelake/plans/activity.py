"""Queries of the conversation and activity family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import activity as A
from tracelake.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _landed(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as landed transcript lines of two dialects, one file a conversation, each with a meta line first."""
    c = table(spark, d, "conversations")
    path = F.concat(F.lit("/logs/"), F.when(F.col("conv_id") % 2 == 0, "alpha").otherwise("beta"), F.lit("/s"), F.col("conv_id"), F.lit(".jsonl"))
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("note").alias("type"), F.col("role").alias("text")))
    nested = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", block.alias("content")).alias("message")))
    flat = F.to_json(F.struct(F.lit("item").alias("type"), F.struct("role", F.col("text").alias("content")).alias("payload")))
    lines = c.select(path.alias("file_path"), (F.col("turn") + 2).alias("line"), F.when(F.col("conv_id") % 2 == 0, nested).otherwise(flat).alias("body"))
    meta = c.select(path.alias("file_path"), F.lit(1).cast("long").alias("line"), F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("c"), F.col("conv_id")).alias("id"), F.lit("/w").alias("cwd")).alias("payload"))).alias("body")).distinct()
    return lines.unionByName(meta)


@query("""SELECT '/logs/' || CASE WHEN event_type < 'f' THEN 'a/deep' ELSE 'b' END || '/' || event_id || '.jsonl' AS path, CASE WHEN event_type < 'f' THEN 'deep' ELSE 'plain' END AS kind, event_id::VARCHAR AS session_id FROM events""")
def d1_transcript_entries(spark: SparkSession, d: str) -> DataFrame:
    folder = F.when(F.col("event_type") < "f", "a/deep").otherwise("b")
    files = table(spark, d, "events").select(F.concat(F.lit("/logs/"), folder, F.lit("/"), F.col("event_id"), F.lit(".jsonl")).alias("path"))
    kinds = spark.createDataFrame([("/logs", "plain"), ("/logs/a/deep", "deep")], "prefix string, kind string")
    return A.transcript_entries(files, F.broadcast(kinds)).select("path", "kind", "session_id")


@query("""SELECT user_id AS session_id, max(ts) AS newest FROM events LEFT JOIN (SELECT user_id AS u, min(ts) + INTERVAL 20 DAY AS stored_at FROM events WHERE user_id % 3 <> 0 GROUP BY 1) ON u = user_id GROUP BY user_id HAVING bool_or(stored_at IS NULL OR ts > stored_at)""")
def d2_stale_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stored = e.where("user_id % 3 <> 0").groupBy(F.col("user_id").alias("session_id")).agg((F.min("ts") + F.expr("interval 20 days")).alias("stored_at"))
    return A.stale_sessions(e.select(F.col("user_id").alias("session_id"), F.col("ts").alias("mtime")), stored)


@query("""WITH c AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS f FROM conversations)
SELECT '/logs/' || f || '/s' || conv_id || '.jsonl' || ':' || (turn + 2) || ':' || i AS block_key, 'c' || conv_id AS session_id, role, CASE i WHEN 0 THEN 'text' ELSE 'note' END AS block_type, md5(CASE i WHEN 0 THEN text ELSE role END) AS content_md5 FROM c, (VALUES (0), (1)) v(i) WHERE i = 0 OR conv_id % 2 = 0""")
def d3_message_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = A.message_blocks(_landed(spark, d))
    return b.select("block_key", "session_id", "role", "block_type", F.md5(F.encode("content", "utf-8")).alias("content_md5"))


@query("""SELECT 'c' || conv_id AS session_id, '/w' AS cwd, count(*) * CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM conversations GROUP BY conv_id""")
def d4_meta_carried(spark: SparkSession, d: str) -> DataFrame:
    return A.message_blocks(_landed(spark, d)).groupBy("session_id", "cwd").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role = 'user' AND NOT (starts_with(text, 'The') OR starts_with(text, 'De')) AS is_prompt FROM conversations")
def d5_typed_prompts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", A.is_prompt(F.col("role"), F.lit("text"), F.col("text"), ["The", "De"]).alias("is_prompt"))


@query("SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY md5(text)) AS is_repeat FROM documents")
def d6_mark_repeats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("id"))
    return A.mark_repeats(docs, "id", ["doc_id"]).select("doc_id", "is_repeat")


_CALLS = """WITH b AS (SELECT user_id, event_type, ts, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS call_id FROM events WHERE event_type IN ('click', 'purchase'))"""


@query(_CALLS + """ SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.call_id, b.call_id) AS call_id, a.value, b.value AS result_value, a.ts IS NOT NULL AND b.ts IS NOT NULL AS paired,
CAST(floor(epoch_us(b.ts) / 1000) - floor(epoch_us(a.ts) / 1000) AS BIGINT) AS returned_ms FROM (FROM b WHERE event_type = 'click') a FULL JOIN (FROM b WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.call_id = b.call_id""")
def d7_pair_calls(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, d, "events").where("event_type in ('click', 'purchase')")
    e = e.withColumn("call_id", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts")).cast("long")).withColumn("kind", F.when(F.col("event_type") == "click", "call").otherwise("result"))
    return A.pair_calls(e, "user_id", "call_id", "kind", "ts", ["value"]).select("user_id", "call_id", "value", "result_value", "paired", "returned_ms")


@query("SELECT conv_id, turn, left(text, 80) AS head, CASE WHEN length(text) > 80 THEN right(text, 40) END AS tail, length(text) AS n_chars FROM conversations")
def d8_previews(spark: SparkSession, d: str) -> DataFrame:
    return A.previews(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text").withColumn("n_chars", F.col("n_chars").cast("long"))


@query()
def d9_near_repeats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").withColumn("h", F.left("text", F.lit(20)))
    return A.near_repeats(c, "h", "doc_id", "text").select("doc_id", F.round("similarity", 4).alias("similarity"))


@query("""SELECT user_id, min(ts) AS started, max(ts) AS last, count(*) AS n_blocks, arg_max(event_type, (ts, event_id)) AS latest_type, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, string_agg(event_id, ',' ORDER BY ts, event_id) AS keys FROM events GROUP BY user_id""")
def d10_sessions(spark: SparkSession, d: str) -> DataFrame:
    return A.sessions(table(spark, d, "events"), "user_id", "ts", "event_id").withColumn("keys", F.array_join(F.transform("keys", lambda k: k.cast("string")), ","))


@query("""WITH p AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next_ts FROM events WHERE event_type = 'click')
SELECT p.event_id, p.user_id, arg_max(v.event_id, v.ts) AS reply_id, max(v.ts) AS reply_ts FROM p LEFT JOIN (FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts >= p.ts AND (p.next_ts IS NULL OR v.ts < p.next_ts) GROUP BY ALL""")
def d11_turns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    replies = e.where("event_type = 'view'").select("user_id", "ts", F.col("ts").alias("reply_ts"), F.col("event_id").alias("reply_id"))
    return A.turns(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), replies, "user_id", "ts", ["reply_ts", "reply_id"]).select("event_id", "user_id", "reply_id", "reply_ts")


@query("SELECT user_id, arg_max(event_id, ts) AS last_click FROM events WHERE event_type = 'click' GROUP BY user_id")
def d12_latest_turn(spark: SparkSession, d: str) -> DataFrame:
    t = d11_turns(spark, d)
    return t.groupBy("user_id").agg(F.max("event_id").alias("last_click"))


@query("""WITH s AS (SELECT user_id AS session, arg_max(event_type, ts) AS branch, max(ts) AS last FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1),
l AS (SELECT *, CAST(floor((epoch(TIMESTAMP '2024-01-20 00:00:00') - floor(epoch(last))) / 60) AS BIGINT) AS idle FROM s), v AS (SELECT * FROM l WHERE idle BETWEEN 0 AND 600)
SELECT v.session, v.branch, v.idle, count(o.session) AS n_others, coalesce(string_agg(o.session, ',' ORDER BY o.session), '') AS others FROM v LEFT JOIN v o ON o.branch = v.branch AND o.session <> v.session AND o.branch <> 'error' GROUP BY ALL""")
def d13_live_sessions(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    seen = table(spark, d, "events").where(F.col("ts") <= now).groupBy(F.col("user_id").alias("session")).agg(F.max_by("event_type", "ts").alias("branch"), F.max("ts").alias("last"))
    live = A.live_sessions(seen, now, 600, ["error"])
    return live.withColumn("others", F.array_join(F.col("others").cast("array<string>"), ","))


@query("""WITH rules(rule, words) AS (VALUES ('notice', ['licensed', 'under']), ('both', ['the', 'and', 'of', 'that']), ('german', ['der', 'die', 'und', 'zu'])),
t AS (SELECT doc_id, regexp_split_to_array(translate(lower(text), '.,;:|!?()', '         '), ' +') AS tokens FROM documents) SELECT doc_id, rule FROM t JOIN rules ON list_has_all(tokens, words)""")
def d14_external_actions(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("notice", ["licensed", "under"]), ("both", ["the", "and", "of", "that"]), ("german", ["der", "die", "und", "zu"])], "rule string, words array<string>")
    return A.external_actions(table(spark, d, "documents").select("doc_id", "text"), F.broadcast(rules), "text").select("doc_id", "rule")


@query("SELECT conv_id, turn, 'tool' AS how FROM conversations WHERE role = 'system' UNION ALL SELECT conv_id, turn, 'message' FROM conversations WHERE role = 'assistant' AND contains(text, '.' || chr(10))")
def d15_plans(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    tool = c.where("role = 'system'").select("conv_id", "turn", F.lit("tool").alias("how"))
    return tool.unionByName(c.where((F.col("role") == "assistant") & F.col("text").contains(".\n")).select("conv_id", "turn", F.lit("message").alias("how")))


@query("""SELECT event_type, count(*) AS runs, round(median(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 4) AS med, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS top, count_if(CAST(json_extract_string(props, '$.k') AS INTEGER) > 90) AS timeouts FROM events GROUP BY 1""")
def d16_attachment_stats(spark: SparkSession, d: str) -> DataFrame:
    f = A.attachment_fields(table(spark, d, "events").select("event_type", "props"), "props").where("key = 'k'").withColumn("v", F.col("val").cast("int"))
    return f.groupBy("event_type").agg(F.count("*").alias("runs"), F.round(F.median("v"), 4).alias("med"), F.max("v").alias("top"), F.count_if(F.col("v") > 90).alias("timeouts"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey > 0), t AS (SELECT child AS node, parent AS root, 1 AS depth FROM e UNION ALL SELECT t.node, e.parent, t.depth + 1 FROM t JOIN e ON t.root = e.child)
SELECT node, arg_max(root, depth) AS root, max(depth) AS depth FROM t GROUP BY node""")
def d17_threads(spark: SparkSession, d: str) -> DataFrame:
    return A.threads(table(spark, d, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 3").alias("parent")))


@query("SELECT conv_id, count(*) AS n_calls, count_if(role = 'user') AS asked, count_if(length(text) > 400) AS long FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE contains(text, ' and ')) GROUP BY 1")
def d18_retro(spark: SparkSession, d: str) -> DataFrame:
    return A.retro(table(spark, d, "conversations"), "conv_id", "text", " and ", {"asked": F.col("role") == "user", "long": F.length("text") > 400})


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id DESC, turn LIMIT 20")
def d19_recall(spark: SparkSession, d: str) -> DataFrame:
    return A.recall(table(spark, d, "conversations"), "text", "The", [F.desc("conv_id"), "turn"], 20).select("conv_id", "turn")


@query("""WITH l AS (SELECT conv_id, arg_max(text, turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1), t(term) AS (VALUES ('that'), ('nicht'), ('que'))
SELECT conv_id, term FROM l JOIN t ON contains(lower(last), term) WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def d20_claim_guard(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return A.claim_guard(c, "conv_id", "turn", "role", "text", ["that", "nicht", "que"], c.where("role = 'system'"))


@query("SELECT o_custkey, count(*) AS n, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS outcomes, count_if(o_totalprice > 300000) AS flagged, round(100.0 * count_if(o_totalprice > 300000) / count(*), 2) AS percent FROM orders GROUP BY 1")
def d21_author_hygiene(spark: SparkSession, d: str) -> DataFrame:
    return A.author_hygiene(table(spark, d, "orders"), "o_custkey", "o_orderstatus", F.col("o_totalprice") > 300000)


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(DISTINCT o_custkey) AS people, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1 ORDER BY n DESC, day LIMIT 30")
def d22_contributors(spark: SparkSession, d: str) -> DataFrame:
    return A.contributors(table(spark, d, "orders"), "o_custkey", "o_orderdate", F.lit("1997-01-01").cast("timestamp"), 30)

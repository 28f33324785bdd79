"""Queries of the relational family and of the merge and freshness operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.operators import relational as R
from tracelake.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT o_orderkey, o_custkey AS customer, upper(o_orderstatus) AS o_orderstatus, round(o_totalprice * 2, 2) AS doubled FROM orders")
def c1_projection(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").drop("o_orderdate", "o_orderpriority").withColumnsRenamed({"o_custkey": "customer"})
    return o.withColumns({"o_orderstatus": F.upper("o_orderstatus"), "doubled": F.round(F.col("o_totalprice") * 2, 2)}).drop("o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice - l_discount AS net, 2 * (l_extendedprice - l_discount) + l_tax AS gross FROM lineitem")
def c2_lateral_alias(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT l_orderkey, l_linenumber, l_extendedprice - l_discount AS net, 2 * net + l_tax AS gross FROM {l}", l=table(spark, d, "lineitem"))


@query("""SELECT doc_id, lang FROM documents WHERE contains(text, 'th') AND (starts_with(source, 'src1') OR source ILIKE '%SRC2') AND lang IN ('en', 'de', 'fr')
AND (lang, source) IS DISTINCT FROM ('en', 'src1') AND NOT ends_with(text, '!')""")
def c3_filters(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    pair = F.struct(F.col("lang").alias("a"), F.col("source").alias("b"))
    keep = F.col("text").contains("th") & (F.col("source").startswith("src1") | F.col("source").ilike("%SRC2")) & F.col("lang").isin("en", "de", "fr")
    return t.where(keep & ~pair.eqNullSafe(F.struct(F.lit("en").alias("a"), F.lit("src1").alias("b"))) & ~F.col("text").endswith("!")).select("doc_id", "lang")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def c4_equi_join(spark: SparkSession, d: str) -> DataFrame:
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("""SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(spent, 0) AS spent, coalesce(urgent, false) AS urgent FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1) b ON b.o_custkey = c_custkey""")
def c5_left_joins(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    j = table(spark, d, "customer").join(facts, "c_custkey", "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("s", F.lit(0.0)).alias("spent"), F.coalesce("u", F.lit(False)).alias("urgent"))


@query("""SELECT coalesce(a.k, b.k) AS nation, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k""")
def c6_full_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full_outer")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) AS big FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def c7_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    none = c.join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    big = o.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("big")).distinct()
    return none.join(big, "c_custkey", "left").select("c_custkey", F.coalesce("big", F.lit(False)).alias("big"))


@query("""SELECT l.event_id, r.event_id AS view_id, r.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def c8_asof_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return R.asof_join(e.where("event_type = 'purchase'"), right, "user_id", "ts", "view_ts", ["view_id", "view_value"], bucket_seconds=7 * 86400).select("event_id", "view_id", "view_value")


@query("""SELECT l_orderkey, l_linenumber, p.p_partkey FROM lineitem JOIN (SELECT p_partkey, p_retailprice * 50 AS lo, p_retailprice * 50 + 40 AS hi FROM part WHERE p_size < 5) p
ON l_extendedprice >= lo AND l_extendedprice < hi WHERE l_quantity > 49""")
def c9_range_join(spark: SparkSession, d: str) -> DataFrame:
    ranges = table(spark, d, "part").where("p_size < 5").select("p_partkey", (F.col("p_retailprice") * 50).alias("lo"), (F.col("p_retailprice") * 50 + 40).alias("hi"))
    return R.range_join(table(spark, d, "lineitem").where("l_quantity > 49"), ranges, "l_extendedprice", "lo", "hi", 100.0).select("l_orderkey", "l_linenumber", "p_partkey")


@query("""WITH rules(rule, how, word) AS (VALUES (1, 'prefix', 'The'), (2, 'suffix', '.'), (3, 'contains', ' and '), (4, 'contains', 'License'), (5, 'prefix', 'De'))
SELECT doc_id, rule FROM documents JOIN rules ON CASE how WHEN 'prefix' THEN starts_with(text, word) WHEN 'suffix' THEN ends_with(text, word) ELSE contains(text, word) END""")
def c10_theta_join(spark: SparkSession, d: str) -> DataFrame:
    rules = [(1, "prefix", "The"), (2, "suffix", "."), (3, "contains", " and "), (4, "contains", "License"), (5, "prefix", "De")]
    by = {"prefix": lambda w: F.col("text").startswith(w), "suffix": lambda w: F.col("text").endswith(w), "contains": lambda w: F.col("text").contains(w)}
    hits = F.array_compact(F.array(*[F.when(by[how](w), F.lit(i)) for i, how, w in rules]))
    return table(spark, d, "documents").select("doc_id", F.explode(hits).alias("rule"))


@query("""WITH rules(rule, words) AS (VALUES (1, ['of', 'the']), (2, ['der', 'und', 'die']), (3, ['la', 'de', 'que', 'un']), (4, ['with', 'that', 'was', 'from']))
SELECT doc_id, rule FROM (SELECT doc_id, string_split(text, ' ') AS tokens FROM documents) JOIN rules ON list_has_all(tokens, words)""")
def c11_superset_join(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(1, ["of", "the"]), (2, ["der", "und", "die"]), (3, ["la", "de", "que", "un"]), (4, ["with", "that", "was", "from"])], "rule int, words array<string>")
    docs = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("tokens"))
    return R.contains_all(docs, F.broadcast(rules), "tokens", "words").select("doc_id", "rule")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS nation FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def c12_pairs_by_key(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return s.select(F.col("s_suppkey").alias("a"), "nation").join(s.select(F.col("s_suppkey").alias("b"), "nation"), "nation").where("a < b").select("a", "b", "nation")


@query("""SELECT doc_id, i AS line_no, md5(line) AS line_md5 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
def c13_unnest_ordinality(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return t.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.md5(F.encode("line", "utf-8")).alias("line_md5"))


@query("SELECT event_id, k.key AS name, CAST(k.value AS BIGINT) AS n FROM events, LATERAL (SELECT unnest(json_keys(props)) AS key, json_extract_string(props, '$.k') AS value) k")
def c14_lateral_expand(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT event_id, j.key AS name, CAST(j.value AS BIGINT) AS n FROM {e}, LATERAL variant_explode(parse_json(props)) AS j(pos, key, value)", e=table(spark, d, "events"))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def c15_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 < 6), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 > 3)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def c16_except_all_both_ways(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return R.differences(o.where("o_orderkey % 10 < 6").select("o_custkey", "o_orderstatus"), o.where("o_orderkey % 10 > 3").select("o_custkey", "o_orderstatus"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 100")
def c17_group_all_having(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM {l} GROUP BY ALL HAVING n > 100", l=table(spark, d, "lineitem"))


@query("""SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, round(sum(value), 2) AS total, min(event_id) AS first_id, count_if(event_type = 'error') AS errors,
bool_or(value > 300) AS any_big, bool_and(value >= 0) AS all_pos, arg_max(event_type, ts) AS last_type, arg_min(event_type, ts) AS first_type, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, round(median(value), 4) AS med FROM events GROUP BY user_id""")
def c18_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.round(F.sum("value"), 2).alias("total"), F.min("event_id").alias("first_id"),
        F.count_if(F.col("event_type") == "error").alias("errors"), F.bool_or(F.col("value") > 300).alias("any_big"), F.bool_and(F.col("value") >= 0).alias("all_pos"),
        F.max_by("event_type", "ts").alias("last_type"), F.min_by("event_type", "ts").alias("first_type"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.round(F.median("value"), 4).alias("med"),
    )


@query("SELECT l_shipdate::DATE::VARCHAR AS day, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, round(sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END), 2) AS discounted FROM lineitem GROUP BY 1")
def c19_conditional_aggregates(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")
    return table(spark, d, "lineitem").groupBy(day).agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(0.0)), 2).alias("discounted"))


@query("SELECT l_partkey, count(*) AS n, list_sort(list(l_quantity))[((count(*) + 1) // 2)::INT] AS lower_median, max(l_quantity) AS worst FROM lineitem GROUP BY l_partkey")
def c20_lower_median(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), R.lower_median("l_quantity").alias("lower_median"), F.max("l_quantity").alias("worst"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), round(sum(l_quantity), 2) FROM lineitem")
def c21_detail_and_total(spark: SparkSession, d: str) -> DataFrame:
    return R.with_total(table(spark, d, "lineitem"), "l_returnflag", [F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")])


@query("""SELECT event_id, row_number() OVER w AS rn, lag(value) OVER w AS prev, lead(value) OVER w AS next, first_value(value) OVER w AS first_v, round(sum(value) OVER w, 2) AS running,
round(sum(value) OVER (PARTITION BY user_id), 2) AS whole, bool_or(event_type = 'error') OVER (PARTITION BY user_id, event_type) AS err, arg_max(event_id, value) OVER (PARTITION BY user_id) AS best,
max(value) OVER (PARTITION BY user_id) AS top FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def c22_windows(spark: SparkSession, d: str) -> DataFrame:
    """Equal times go by event_id, and of equal highest values the first event's is taken; the running sum has all rows of its time, as RANGE says."""
    p = W.partitionBy("user_id")
    w, peers = p.orderBy("ts", "event_id"), p.orderBy("ts")
    best = F.max_by("event_id", F.struct("value", -F.col("event_id"))).over(p)
    return table(spark, d, "events").select(
        "event_id", F.row_number().over(w).cast("long").alias("rn"), F.lag("value").over(w).alias("prev"), F.lead("value").over(w).alias("next"), F.first("value").over(w).alias("first_v"),
        F.round(F.sum("value").over(peers), 2).alias("running"), F.round(F.sum("value").over(p), 2).alias("whole"), F.bool_or(F.col("event_type") == "error").over(W.partitionBy("user_id", "event_type")).alias("err"),
        best.alias("best"), F.max("value").over(p).alias("top"),
    )


@query("""SELECT user_id, island, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS starts FROM events)) GROUP BY ALL""")
def c23_islands(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) > 6 * 3600 * 1_000_000
    return R.islands(e, ["user_id"], ["ts"], gap).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def c24_top_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer ORDER BY CASE WHEN c_acctbal > 9900 THEN NULL ELSE c_acctbal END DESC NULLS LAST, c_custkey LIMIT 25")
def c25_top_k(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("c_acctbal") > 9900, None).otherwise(F.col("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").orderBy(key.desc_nulls_last(), "c_custkey").limit(25)


@query("SELECT t.name, d.day, count(e.event_id) AS n FROM (SELECT DISTINCT event_type AS name FROM events) t CROSS JOIN (SELECT DISTINCT ts::DATE::VARCHAR AS day FROM events) d LEFT JOIN events e ON e.event_type = t.name AND e.ts::DATE::VARCHAR = d.day GROUP BY ALL")
def c26_pivot_unpivot(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type").count().fillna(0)
    names = [c for c in wide.columns if c != "day"]
    return wide.unpivot("day", names, "name", "n").select("name", "day", "n")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER w AS n, sum(strlen(text)) OVER w AS b, count(*) OVER (PARTITION BY lang) AS total FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id)),
s AS (SELECT *, count_if(n <= 30 AND b <= 60000) OVER (PARTITION BY lang) AS returned FROM r), t AS (SELECT *, max(CASE WHEN n = returned + 1 AND b > 60000 THEN 1 END) OVER (PARTITION BY lang) AS over FROM s)
SELECT CASE WHEN returned > 0 THEN doc_id END AS doc_id, lang, returned, total, returned < total AS truncated, CASE WHEN returned = total THEN NULL WHEN returned = 0 THEN 'oversized_row' WHEN returned >= 30 OR over IS NULL THEN 'rows' ELSE 'bytes' END AS reason FROM t WHERE n <= 30 AND b <= 60000 OR returned = 0 AND n = 1""")
def c27_prefix_budget(spark: SparkSession, d: str) -> DataFrame:
    return R.prefix_budget(table(spark, d, "documents"), ["lang"], ["doc_id"], "text", 30, 60_000).select("doc_id", "lang", "returned", "total", "truncated", "reason")


@query("""SELECT role, conv_id, size, CAST(floor(coalesce(sum(size) OVER (PARTITION BY role ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20000) AS BIGINT) AS batch
FROM (SELECT role, conv_id, CAST(sum(strlen(text)) AS BIGINT) AS size FROM conversations GROUP BY ALL)""")
def c28_pack_batches(spark: SparkSession, d: str) -> DataFrame:
    return R.pack_batches(table(spark, d, "conversations"), ["role"], "conv_id", F.octet_length("text").cast("long"), 20_000)


@query("SELECT o_custkey, o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'now' WHEN '2' THEN 'soon' WHEN '3' THEN 'later' END AS due FROM orders")
def c29_map_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = F.map_from_arrays(F.array(F.lit("1"), F.lit("2"), F.lit("3")), F.array(F.lit("now"), F.lit("soon"), F.lit("later")))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.try_element_at(names, F.left("o_orderpriority", F.lit(1))).alias("due"))


@query("""SELECT doc_id, len(list_distinct(w)) AS n_distinct, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: length(x) > 12)))[1:3], ',') AS longest, list_has_any(w, ['the', 'der']) AS has_any, w[-1] AS last_word,
len(list_filter(w, lambda x: starts_with(x, 'th'))) AS n_th FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def c30_list_functions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    long_words = F.array_sort(F.array_distinct(F.filter("w", lambda x: F.length(x) > 12)))
    return t.select("doc_id", F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.array_join(F.slice(long_words, 1, 3), ",").alias("longest"), F.arrays_overlap("w", F.array(F.lit("the"), F.lit("der"))).alias("has_any"), F.element_at("w", -1).alias("last_word"), F.size(F.filter("w", lambda x: x.startswith("th"))).cast("long").alias("n_th"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def a14_newest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return R.newest_per_key(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01 05:00:00')")
def a15_due(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("event_id").alias("page_id"), "ts")
    return R.due(table(spark, d, "pages").select("page_id"), log, "page_id", "ts", F.lit("2024-01-01 05:00:00").cast("timestamp"))


@query("""SELECT event_id, user_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, user_id FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0""")
def a16_merge_new(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id")
    return R.merge_new(e.where("event_id % 3 = 0"), e.where("event_id % 2 = 0"), ["event_id"])


@query("SELECT user_id, event_type, count(*) AS copies FROM events GROUP BY ALL HAVING count(*) > 1")
def a16_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicate_keys(table(spark, d, "events"), ["user_id", "event_type"])


@query("""WITH s AS (SELECT DISTINCT event_type || '-' || user_id AS table_name FROM events UNION SELECT 'never-' || n_name FROM nation), l AS (SELECT event_type || '-' || user_id AS table_name, ts, CASE WHEN value > 30 THEN 'error' ELSE 'ok' END AS status FROM events),
a AS (SELECT table_name, arg_max(status, ts) AS last_status, max(ts) AS last_finished FROM l GROUP BY 1), b AS (SELECT *, CAST(epoch(TIMESTAMP '2024-01-30 12:00:00') AS BIGINT) - (CAST(floor(epoch(last_finished)) AS BIGINT) + CASE WHEN last_status = 'ok' THEN 300 ELSE 30 END) AS overdue FROM s LEFT JOIN a USING (table_name))
SELECT table_name, last_status, overdue FROM b WHERE overdue IS NULL OR overdue >= 0 ORDER BY overdue DESC NULLS FIRST, table_name LIMIT 40""")
def a20_due_tables(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    name = F.concat_ws("-", "event_type", "user_id").alias("table_name")
    sources = e.select(name).union(table(spark, d, "nation").select(F.concat(F.lit("never-"), F.col("n_name")))).distinct()
    log = e.select(name, "ts", F.when(F.col("value") > 30, "error").otherwise("ok").alias("status"))
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return R.due_tables(sources, log, "table_name", "status", "ts", now, 40).select("table_name", "last_status", "overdue")


@query("""WITH t AS (SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), s AS (SELECT o_orderkey, o_orderdate, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 0),
m AS (SELECT max(o_orderdate) AS mark FROM t), f AS (SELECT s.* FROM s, m WHERE o_orderdate >= mark - INTERVAL 30 DAY), u AS (SELECT *, 0 AS n FROM t UNION ALL SELECT *, 1 FROM f)
SELECT o_orderkey, o_orderdate, round(o_totalprice, 2) AS o_totalprice FROM u WHERE o_orderkey IN (SELECT o_orderkey FROM s) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, n DESC) = 1""")
def a21_incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    source = o.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    merged = R.incremental_merge(o.where("o_orderdate < timestamp'1998-01-01'"), source, ["o_orderkey"], "o_orderdate", F.expr("interval 30 days"))
    return merged.withColumn("o_totalprice", F.round("o_totalprice", 2))

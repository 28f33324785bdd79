"""Queries of the source, sink and publication families, over files that Spark writes from the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources import files as S
from tracelake.sources import publish as P
from tracelake.session import cut, scratch, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT fmt, count(*) AS n, count(DISTINCT c_custkey) AS keys, round(sum(c_acctbal), 2) AS total FROM customer, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) v(fmt) GROUP BY fmt")
def a1_read_any(spark: SparkSession, d: str) -> DataFrame:
    c, base, parts = table(spark, d, "customer"), scratch(spark, "any"), []
    for fmt in ("csv", "json", "orc", "parquet"):
        w = c.write.option("header", "true") if fmt == "csv" else c.write
        w.format(fmt).save(f"{base}/c.{fmt}")
        parts.append(S.read_any(spark, f"{base}/c.{fmt}").select(F.lit(fmt).alias("fmt"), F.col("c_custkey").cast("long"), F.col("c_acctbal").cast("double")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.groupBy("fmt").agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("keys"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS value, CASE WHEN event_id % 2 = 1 THEN props END AS props FROM events")
def a2_read_many(spark: SparkSession, d: str) -> DataFrame:
    e, base = table(spark, d, "events"), scratch(spark, "many")
    e.where("event_id % 2 = 0").select("event_id", "value").write.parquet(f"{base}/a.parquet")
    e.where("event_id % 2 = 1").select("props", "event_id").write.parquet(f"{base}/b.parquet")
    return S.read_many(spark, [f"{base}/a.parquet", f"{base}/b.parquet"]).select("event_id", "value", "props")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Customers by nation, as text files of sorted lines."""
    base = scratch(spark, "lines")
    rows = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("nation"), F.concat_ws(",", "c_nationkey", "c_custkey").alias("value"), "c_custkey")
    rows.repartition("nation").sortWithinPartitions("nation", "c_custkey").select("nation", "value").write.partitionBy("nation").text(base)
    return S.read_lines(spark, base)


@query("SELECT c_nationkey::VARCHAR || ',' || c_custkey AS content, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line_no FROM customer")
def a3_read_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("content", "line_no")


@query("WITH l AS (SELECT c_nationkey::VARCHAR || ',' || c_custkey AS content, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY c_nationkey) AS t FROM customer) SELECT content, 'head' AS part FROM l WHERE n BETWEEN 2 AND 4 UNION ALL SELECT content, 'tail' FROM l WHERE n > t - 3")
def a4_select_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    head = S.select_lines(lines, 2, 4).select("content", F.lit("head").alias("part"))
    return head.unionByName(S.select_lines(lines, tail=3).select("content", F.lit("tail").alias("part")))


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def a5_read_ndjson(spark: SparkSession, d: str) -> DataFrame:
    base = scratch(spark, "ndjson")
    good = table(spark, d, "events").select(F.concat(F.lit('{"id": "'), "event_id", F.lit('", "kind": "'), "event_type", F.lit('", "extra": '), "props", F.lit("}")).alias("value"))
    good.union(spark.createDataFrame([("no json",), ("[1, 2]",)], "value string")).write.text(base)
    v = S.read_ndjson_shallow(spark, base, ["id", "kind", "extra"])
    return v.select(F.variant_get("id", "$", "string").alias("id"), F.variant_get("kind", "$", "string").alias("kind"), F.variant_get("extra", "$.k", "int").alias("k"))


@query("""SELECT 'id' AS field, count(*) AS n, 'STRING' AS kinds, false AS mixed FROM events UNION ALL SELECT 'v', count(*), 'NUMBER,STRING', true FROM events UNION ALL SELECT 'k.' || event_type, count(*), 'ARRAY', false FROM events GROUP BY event_type
UNION ALL SELECT 'maybe', count(*), 'BOOLEAN,NULL', false FROM events WHERE event_id % 3 > 0 UNION ALL SELECT NULL, count(*), '', false FROM events WHERE event_id % 5 = 0""")
def a5_discover_fields(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines with a field named by their kind and values of mixed kinds, and a broken line for every fifth."""
    v = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    maybe = F.when(F.col("event_id") % 3 == 1, ', "maybe": null').when(F.col("event_id") % 3 == 2, ', "maybe": true').otherwise("")
    body = F.concat(F.lit('{"id": "'), "event_id", F.lit('", "v": '), v, F.lit(', "k.'), "event_type", F.lit('": [1]'), maybe, F.lit("}"))
    e = table(spark, d, "events")
    lines = e.select(body.alias("content")).union(e.where("event_id % 5 = 0").select(F.concat(F.lit('{"id": '), "event_type")))
    return S.discover_fields(lines).select("field", "n", F.array_join(F.array_sort(F.map_keys("types")), ",").alias("kinds"), "mixed")


@query("SELECT source || '-' || doc_id % 10 AS part, count(DISTINCT 1) AS files, CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS chars FROM documents GROUP BY 1")
def a6_read_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as text files, one for each source and last digit of the id."""
    base = scratch(spark, "docs")
    docs = table(spark, d, "documents").select(F.concat_ws("-", "source", F.col("doc_id") % 10).alias("part"), "text")
    docs.repartition("part").write.partitionBy("part").text(base)
    files = S.list_files(spark, base, content=True).where("name like 'part-%'").withColumn("part", F.regexp_extract("path", "part=([^/]+)/", 1))
    return files.groupBy("part").agg(F.count("*").alias("files"), F.sum(F.length(F.regexp_replace("content", "\n", ""))).alias("chars"))


@query("SELECT count(DISTINCT event_type) AS folders, true AS has_bytes FROM events")
def a7_list_files(spark: SparkSession, d: str) -> DataFrame:
    base = scratch(spark, "list")
    table(spark, d, "events").write.partitionBy("event_type").parquet(base)
    f = S.list_files(spark, base).where("name like 'part-%'")
    return f.agg(F.countDistinct(F.regexp_extract("path", "event_type=([^/]+)", 1)).alias("folders"), F.bool_and(F.col("length") > 0).alias("has_bytes"))


@query("SELECT event_type, count(*) AS rows FROM events GROUP BY 1")
def a8_parquet_stats(spark: SparkSession, d: str) -> DataFrame:
    base = scratch(spark, "stats")
    table(spark, d, "events").write.partitionBy("event_type").parquet(base)
    return S.parquet_stats(spark, base).groupBy(F.regexp_extract("file_path", "event_type=([^/]+)", 1).alias("event_type")).agg(F.sum("rows").alias("rows"))


@query("SELECT event_type, count(*) AS rows, 0::BIGINT AS nulls, min(event_id) AS low, max(event_id) AS high, true AS groups FROM events GROUP BY 1")
def a8_row_groups(spark: SparkSession, d: str) -> DataFrame:
    """Events written in row groups of at most some kilobytes: their rows and what their footers say of event_id."""
    base = scratch(spark, "groups")
    table(spark, d, "events").repartition(2, "event_type").write.option("parquet.block.size", 16384).partitionBy("event_type").parquet(base)
    g = S.row_groups(spark, base).select(F.regexp_extract("file_path", "event_type=([^/]+)", 1).alias("event_type"), "row_group", "rows", F.filter("columns", lambda c: c["name"] == "event_id")[0].alias("c"))
    return g.groupBy("event_type").agg(F.sum("rows").alias("rows"), F.sum("c.nulls").alias("nulls"), F.min(F.col("c.low").cast("long")).alias("low"), F.max(F.col("c.high").cast("long")).alias("high"), (F.count("*") > 0).alias("groups"))


_LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, regexp_replace(min({c})::VARCHAR, '^-0.0$', '0.0') AS low, max({c})::VARCHAR AS high FROM lineitem" for c in _LINEITEM))
def a9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column, merged from the profiles of the two kinds of line status."""
    t = table(spark, d, "lineitem").select(*_LINEITEM)
    parts = S.profile(t.where("l_linestatus = 'F'")).unionByName(S.profile(t.where("l_linestatus <> 'F'")))
    return S.merge_profiles(parts).select("column", "n", "nulls", "low", "high")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {q} AS rank, true AS close FROM lineitem HAVING count(*) > 0" for c in ("l_extendedprice", "l_partkey", "l_quantity") for q in (0.1, 0.5, 0.99)))
def a9_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of merged sketches: whether the share of rows below and up to each encloses its rank, within 1.5 %."""
    t, ranks = table(spark, d, "lineitem").select("l_extendedprice", "l_partkey", "l_quantity", "l_linestatus"), (0.1, 0.5, 0.99)
    parts = S.profile(t.where("l_linestatus = 'F'")).unionByName(S.profile(t.where("l_linestatus <> 'F'")))
    q = S.quantiles(S.merge_profiles(parts), ranks).select("column", F.posexplode("quantiles").alias("i", "v")).select("column", F.get(F.array(*map(F.lit, ranks)), F.col("i")).alias("rank"), "v")
    long = t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in t.columns[:3]])).alias("s")).select("s.*")
    share = long.join(F.broadcast(q), "column").groupBy("column", "rank").agg(F.avg((F.col("x") < F.col("v")).cast("int")).alias("below"), F.avg((F.col("x") <= F.col("v")).cast("int")).alias("upto"))
    return share.select("column", F.col("rank").cast("decimal(3,2)").alias("rank"), ((F.col("below") - 0.015 <= F.col("rank")) & (F.col("upto") + 0.015 >= F.col("rank"))).alias("close"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def a10_convert(spark: SparkSession, d: str) -> DataFrame:
    back = S.convert(table(spark, d, "orders"), scratch(spark, "convert"), "parquet", ["o_orderstatus"], "zstd")
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT 'customer' AS \"table\", count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'nation', count(*) FROM nation")
def a11_export_import(spark: SparkSession, d: str) -> DataFrame:
    base = scratch(spark, "export")
    S.export_tables({n: table(spark, d, n) for n in ("customer", "orders", "nation")}, base)
    back = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in S.import_tables(spark, base).items()]
    return back[0].unionByName(back[1]).unionByName(back[2])


@query("SELECT event_id, event_type, user_id % 4 AS signature FROM events")
def a12_append_log(spark: SparkSession, d: str) -> DataFrame:
    base, e = scratch(spark, "log"), table(spark, d, "events").withColumn("signature", F.col("user_id") % 4)
    for i in (0, 1):
        S.append_log(e.where(F.col("event_id") % 2 == i).select("event_id", "event_type", "signature"), base, ["event_type", "signature"])
    return S.read_log(spark, base).select("event_id", "event_type", F.col("signature").cast("long").alias("signature"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 1 THEN value END AS value, event_type FROM events")
def a13_read_log(spark: SparkSession, d: str) -> DataFrame:
    base, e = scratch(spark, "shapes"), table(spark, d, "events")
    S.append_log(e.where("event_id % 2 = 0").select("event_id", "event_type"), base, ["event_type"])
    S.append_log(e.where("event_id % 2 = 1").select("event_id", "value", "event_type"), base, ["event_type"])
    return S.read_log(spark, base).select("event_id", "value", "event_type")


@query("SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN page_id % 7 <> 0 THEN length(html)::VARCHAR END AS body FROM pages")
def a17_fan_out(spark: SparkSession, d: str) -> DataFrame:
    def call(row: dict) -> str:
        if row["page_id"] % 7 == 0:
            raise RuntimeError("refused")
        return str(len(row["html"]))

    return S.fan_out(table(spark, d, "pages").select("page_id", "html"), "page_id", call, 4).select("page_id", "status", "body")


@query("SELECT page_id, CASE WHEN page_id % 7 = 0 OR page_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN page_id % 7 = 0 THEN 'fetch' ELSE 'parse' END AS stage FROM pages")
def a18_stages(spark: SparkSession, d: str) -> DataFrame:
    def fetch(row: dict) -> str:
        if row["page_id"] % 7 == 0:
            raise RuntimeError("refused")
        return row["url"]

    def parse(row: dict) -> str:
        if row["page_id"] % 5 == 0:
            raise ValueError("unreadable")
        return row["body"].upper()

    return S.stages(table(spark, d, "pages").select("page_id", "url"), "page_id", [("fetch", fetch), ("parse", parse)], 4).select("page_id", "status", "stage")


@query("SELECT 'customer' AS table_name, count(*) AS rows, 'ok' AS status FROM customer UNION ALL SELECT 'nation', count(*), 'ok' FROM nation UNION ALL SELECT 'gone', NULL, 'error'")
def a19_snapshot_tables(spark: SparkSession, d: str) -> DataFrame:
    base = scratch(spark, "snapshot")
    sources = {"customer": lambda: table(spark, d, "customer"), "gone": lambda: table(spark, d, "gone"), "nation": lambda: table(spark, d, "nation")}
    S.snapshot_tables(sources, base, f"{base}/_log", spark, F.lit("2024-01-01").cast("timestamp"))
    return spark.read.parquet(f"{base}/_log").select("table_name", "rows", "status")


@query()
def a22_fake_rows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").count()
    return S.fake_rows(spark, n, {"amount": "double", "word": "word", "day": "date", "none": "null"}, seed=7)


@query()
def a23_semantic_types(spark: SparkSession, d: str) -> DataFrame:
    return S.infer_semantic_types(table(spark, d, "pages").unionByName(table(spark, d, "events"), allowMissingColumns=True))


@query("SELECT 'ok' AS verdict, true AS complete, count(*) AS rows FROM documents")
def a24_publish_objects(spark: SparkSession, d: str) -> DataFrame:
    base = scratch(spark, "evidence")
    manifest = S.publish_objects(table(spark, d, "documents"), base, "crawler", "r1")
    audited = S.audit_objects(spark, base, "crawler", "r1").join(manifest.select("file", "rows"), "file", "left")
    return audited.groupBy("verdict").agg((F.count("*") == F.count("rows")).alias("complete"), F.sum("rows").alias("rows"))


def _published(spark: SparkSession, d: str) -> P.Table:
    """Orders of three years as partitions; the middle one published twice, the last cleared and filled."""
    t = P.Table(scratch(spark, "pub"), "shop", "orders", schema="ds string, o_orderkey long, o_totalprice double").check_not_null("o_orderkey")
    t = t.check("key is unique", lambda s: s.groupBy("o_orderkey").count().where("count > 1"))
    o = table(spark, d, "orders")
    for day, (year, rows) in enumerate((("1996", "year(o_orderdate) = 1996"), ("1997", "year(o_orderdate) = 1997"), ("1997", "year(o_orderdate) = 1997 and o_orderkey % 2 = 0"), ("1998", "false"), ("1998", "year(o_orderdate) = 1998")), 1):
        P.publish(o.where(rows).withColumn("ds", F.lit("wrong")).withColumn("extra", F.lit(1)), t, {"ds": year}, at=datetime(2024, 1, day))
    return t


_PUBLISHED = "WITH p AS (SELECT year(o_orderdate)::VARCHAR AS ds, o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) IN (1996, 1998) OR year(o_orderdate) = 1997 AND o_orderkey % 2 = 0) "


@query(_PUBLISHED + "SELECT * FROM p")
def b1_publish_partition(spark: SparkSession, d: str) -> DataFrame:
    return P.read_version(spark, _published(spark, d)).select("ds", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus, 'x' AS ds FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, 'x' FROM orders WHERE o_orderkey % 3 = 1")
def b2_replace_insert(spark: SparkSession, d: str) -> DataFrame:
    t, o = P.Table(scratch(spark, "pub"), "shop", "mix"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    P.publish(o, t, {"ds": "x"})
    P.publish(o.where("o_orderkey % 3 = 0"), t, {"ds": "x"}, "replace")
    P.publish(o.where("o_orderkey % 3 = 1").select("o_orderstatus", "o_orderkey"), t, {"ds": "x"}, "insert")
    return P.read_version(spark, t)


@query("SELECT s_suppkey, '2024-01' AS ds, 'NL' AS country FROM supplier UNION ALL SELECT s_suppkey, '2024-01', 'it''s' FROM supplier WHERE s_suppkey % 2 = 0")
def b3_partition_columns(spark: SparkSession, d: str) -> DataFrame:
    t, s = P.Table(scratch(spark, "pub"), "shop", "suppliers", ("ds", "country")), table(spark, d, "supplier").select("s_suppkey", F.lit("mine").alias("country"))
    P.publish(s, t, {"ds": "2024-01", "country": "NL"})
    P.publish(s.where("s_suppkey % 2 = 0"), t, {"ds": "2024-01", "country": "it's"})
    return P.read_version(spark, t)


@query("SELECT count(*) AS violations FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def b7_check_violations(spark: SparkSession, d: str) -> DataFrame:
    """The rows that a uniqueness check of the line items finds; with them, publication is refused."""
    found = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    return found.agg(F.count("*").alias("violations"))


@query(_PUBLISHED + "SELECT ds AS latest, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM p WHERE ds = (SELECT max(ds) FROM p) GROUP BY ds")
def b11_latest_partition(spark: SparkSession, d: str) -> DataFrame:
    t = _published(spark, d)
    latest = P.latest_partition(spark, t)
    return P.read_version(spark, t).where(F.col("ds") == latest).groupBy(F.col("ds").alias("latest")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderpriority = '1-URGENT' GROUP BY 1")
def b13_run_context(spark: SparkSession, d: str) -> DataFrame:
    ctx = P.RunContext("1998-01-01", params=(("priority", "1-URGENT"),))
    return ctx.sql(spark, "SELECT o_orderstatus, count(*) AS n FROM {o} WHERE o_orderdate >= to_timestamp(:ds) AND o_orderpriority = :priority GROUP BY 1", o=table(spark, d, "orders"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def b14_land(spark: SparkSession, d: str) -> DataFrame:
    base, o = scratch(spark, "land"), table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    P.land(o, base, ["o_orderstatus"])
    P.land(o.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)), base, ["o_orderstatus"])
    return spark.read.parquet(base).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("""SELECT 1::BIGINT AS version, count(*) AS rows FROM orders WHERE year(o_orderdate) = 1996 UNION ALL SELECT 2, count(*) FROM orders WHERE year(o_orderdate) IN (1996, 1997) UNION ALL SELECT 3, count(*) FROM orders WHERE year(o_orderdate) = 1996 OR year(o_orderdate) = 1997 AND o_orderkey % 2 = 0
UNION ALL SELECT 4, count(*) FROM orders WHERE year(o_orderdate) = 1996 OR year(o_orderdate) = 1997 AND o_orderkey % 2 = 0 UNION ALL SELECT 5, count(*) FROM orders WHERE year(o_orderdate) IN (1996, 1998) OR year(o_orderdate) = 1997 AND o_orderkey % 2 = 0""")
def b17_read_versions(spark: SparkSession, d: str) -> DataFrame:
    t = _published(spark, d)
    parts = [P.read_version(spark, t, v).agg(F.count("*").alias("rows")).select(F.lit(v).cast("long").alias("version"), "rows") for v in range(1, 6)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT v AS version, v BETWEEN 4 AND 5 AS readable, CASE WHEN v = 4 THEN (SELECT count(*) FROM orders WHERE year(o_orderdate) = 1996 OR year(o_orderdate) = 1997 AND o_orderkey % 2 = 0) WHEN v = 5 THEN (SELECT count(*) FROM orders WHERE year(o_orderdate) IN (1996, 1998) OR year(o_orderdate) = 1997 AND o_orderkey % 2 = 0) END AS n,
CASE WHEN v = 3 THEN (SELECT count(*) FROM orders WHERE year(o_orderdate) = 1997) WHEN v = 6 THEN (SELECT count(*) FROM orders WHERE year(o_orderdate) <> 1997) END AS swept FROM (SELECT unnest(range(1, 7)) AS v)""")
def b19_expire(spark: SparkSession, d: str) -> DataFrame:
    """Five versions a day apart, of which those older than the fourth day expire, and a publication that its checks refused.

    A row a version: whether it can be read after the sweep and its rows; swept: rows of the files that were deleted, at
    the version that made way for them. The year published twice loses its first copy, and the refused rows go too.
    """
    t = _published(spark, d)
    try:
        P.publish(table(spark, d, "orders").where("year(o_orderdate) <> 1997"), t.check("none", lambda s: s), {"ds": "1999"})
    except P.CheckFailed:
        pass
    P.expire(spark, t, datetime(2024, 1, 4))
    late = datetime(2100, 1, 1)
    strays = [r["path"] for r in P.stray_files(spark, t, late).collect()]
    rows = spark.read.schema("ds string, o_orderkey long").parquet(*strays)
    swept = cut(rows.groupBy(F.when(F.col("ds") == "1997", 3).otherwise(6).cast("long").alias("version")).agg(F.count("*").alias("swept")))
    P.sweep(spark, t, late)
    known = []
    for v in range(1, 7):
        try:
            known.append((v, True, P.read_version(spark, t, v).count()))
        except LookupError:
            known.append((v, False, None))
    return spark.createDataFrame(known, "version long, readable boolean, n long").join(swept, "version", "left")


@query("SELECT o_orderkey, floor(o_totalprice)::BIGINT AS o_totalprice, 'x' AS ds FROM orders")
def b5_typed_stage(spark: SparkSession, d: str) -> DataFrame:
    """A declared schema: columns by name, cast, extras ignored; the price is declared a whole number."""
    t = P.Table(scratch(spark, "pub"), "shop", "typed", schema="ds string, o_totalprice decimal(18,0), o_orderkey long")
    P.publish(table(spark, d, "orders").withColumns({"ds": F.lit("mine"), "o_totalprice": F.floor("o_totalprice")}), t, {"ds": "x"})
    return P.read_version(spark, t).select("o_orderkey", F.col("o_totalprice").cast("long").alias("o_totalprice"), "ds")


def _refused(spark: SparkSession, d: str) -> tuple[P.Table, list[str]]:
    """Orders published once, then two publications that their checks refuse."""
    t, o, errors = P.Table(scratch(spark, "pub"), "shop", "checked"), table(spark, d, "orders").select("o_orderkey", "o_custkey"), []
    P.publish(o, t, {"ds": "a"})
    for bad in (t.check_not_null("o_custkey"), t.check("customers are few", lambda s: s.where("o_custkey > 10"))):
        try:
            P.publish(o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey"))), bad, {"ds": "a"})
        except P.CheckFailed as e:
            errors.append(str(e))
    return t, errors


@query("SELECT 'o_custkey is null in ' || count(*) || ' rows' AS error FROM orders WHERE o_orderkey % 5 = 0")
def b6_not_null(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(_refused(spark, d)[1][0],)], "error string")


@query("SELECT o_orderkey, o_custkey, 'a' AS ds FROM orders")
def b8_failed_checks_keep_rows(spark: SparkSession, d: str) -> DataFrame:
    t, errors = _refused(spark, d)
    assert len(errors) == 2
    return P.read_version(spark, t)


@query("SELECT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'NULL') AS wanted, true AS landed, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'x', false, 0")
def b10_waits(spark: SparkSession, d: str) -> DataFrame:
    """Partitions of two keys are matched null-safe; one that has not landed is not there."""
    t, o = P.Table(scratch(spark, "pub"), "shop", "waited", ("ds", "status")), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for status, rows in (("F", "o_orderstatus = 'F'"), ("O", "o_orderstatus = 'O'"), (None, "o_orderstatus = 'P'")):
        P.publish(o.where(rows), t, {"ds": "a", "status": status})
    landed = [(s or "NULL", P.has_partition(spark, t, {"ds": "a", "status": s})) for s in ("F", "O", None, "x")]
    n = P.read_version(spark, t).groupBy(F.coalesce("status", F.lit("NULL")).alias("wanted")).agg(F.count("*").alias("n"))
    return spark.createDataFrame(landed, "wanted string, landed boolean").join(n, "wanted", "left").fillna(0, ["n"])


@query("SELECT 'shop' AS namespace, 'receipts' AS \"table\", count(*) AS rows, 5::BIGINT AS columns FROM customer WHERE c_acctbal > 0")
def b16_receipt(spark: SparkSession, d: str) -> DataFrame:
    t = P.Table(scratch(spark, "pub"), "shop", "receipts")
    r = P.publish(table(spark, d, "customer").drop("c_mktsegment").where("c_acctbal > 0"), t, {"ds": "a"})
    return spark.createDataFrame([(r["namespace"], r["table"], r["rows"], r["columns"])], "namespace string, table string, rows long, columns long")


@query("SELECT 'one' AS base, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders UNION ALL SELECT 'two', count(*), round(sum(c_acctbal), 2) FROM customer")
def b18_two_catalogs(spark: SparkSession, d: str) -> DataFrame:
    base = scratch(spark, "pub")
    one, two = P.Table(f"{base}/one", "shop", "t"), P.Table(f"{base}/two", "shop", "t")
    P.publish(table(spark, d, "orders").select(F.col("o_totalprice").alias("v")), one, {"ds": "a"})
    P.publish(table(spark, d, "customer").select(F.col("c_acctbal").alias("v")), two, {"ds": "a"})
    parts = [P.read_version(spark, t).agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total")).select(F.lit(n).alias("base"), "n", "total") for n, t in (("one", one), ("two", two))]
    return parts[0].unionByName(parts[1])

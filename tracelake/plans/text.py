"""Queries of the page, document and text family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import text as X
from tracelake.operators.text_index import TextIndex
from tracelake.session import parts_of, scratch, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query()
def f1_page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return X.page_blocks(table(spark, d, "pages"))


_LINKS = """WITH links AS (SELECT page_id AS id, url AS base, unnest(regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
resolved AS (SELECT *, CASE WHEN starts_with(href, '/') THEN regexp_extract(base, '^(https?://[^/]+)', 1) || href WHEN regexp_matches(href, '^[a-z]+:') THEN href ELSE regexp_extract(base, '^(.*/)[^/]*$', 1) || href END AS url FROM links) """


@query(_LINKS + "SELECT id, pos, href, url FROM resolved")
def f2_page_links(spark: SparkSession, d: str) -> DataFrame:
    return X.page_links(table(spark, d, "pages")).select("id", F.col("pos").cast("long").alias("pos"), "href", "url")


def _with_tables(spark: SparkSession, d: str, hidden: bool) -> DataFrame:
    """Parts as pages with a table each, hidden in a comment for odd keys if asked."""
    row = F.concat(F.lit("<tr><td>"), "p_name", F.lit("</td><td>"), "p_brand", F.lit("</td></tr>"))
    body = F.concat(F.lit("<table><tr><th>name</th><th>brand</th></tr>"), row, row, F.lit("</table>"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.when((F.col("p_partkey") % 2 == 1) & F.lit(hidden), F.concat(F.lit("<!-- "), body, F.lit(" -->"))).otherwise(body).alias("html"))


@query("SELECT p_partkey AS id, r::INT AS row, p_brand AS brand, p_name AS name, NULL::VARCHAR AS size FROM part, (VALUES (1), (2)) v(r)")
def f3_page_tables(spark: SparkSession, d: str) -> DataFrame:
    return X.typed_table(X.page_tables(_with_tables(spark, d, False)), ["brand", "name", "size"]).select("id", "row", "brand", "name", "size")


@query("SELECT p_partkey AS id, CASE p_partkey % 2 WHEN 1 THEN 'hidden' ELSE 'open' END AS kind, 3::BIGINT AS n FROM part")
def f4_hidden_tables(spark: SparkSession, d: str) -> DataFrame:
    pages = _with_tables(spark, d, True)
    every, seen = X.page_tables(pages, comments=True), X.page_tables(pages).select("id").distinct().withColumn("open", F.lit(1))
    return every.groupBy("id").agg(F.count("*").alias("n")).join(seen, "id", "left").select("id", F.when(F.col("open") == 1, "open").otherwise("hidden").alias("kind"), "n")


@query()
def f5_page_nodes(spark: SparkSession, d: str) -> DataFrame:
    return X.page_nodes(table(spark, d, "pages")).select("tree_id", "node_id", "parent_id", "depth", "tag", "path", "descendants")


@query(_LINKS + "SELECT id AS tree_id, href FROM links")
def f6_text_at(spark: SparkSession, d: str) -> DataFrame:
    nodes = X.text_at(X.page_nodes(table(spark, d, "pages")), "html/body/nav")
    return nodes.where("tag = 'a'").select("tree_id", F.col("attrs")["href"].alias("href"))


@query(_LINKS + """SELECT page_id AS id, length(html) AS n_chars, left(html, 60) AS preview, f.first_links FROM pages LEFT JOIN (SELECT id, string_agg(href, ' ' ORDER BY pos) AS first_links FROM links WHERE pos < 8 GROUP BY id) f ON f.id = page_id""")
def f7_page_summary(spark: SparkSession, d: str) -> DataFrame:
    return X.page_summary(table(spark, d, "pages"))


@query("SELECT url, count(*) AS copies, count(DISTINCT md5(body)) AS bodies FROM (SELECT url, html AS body FROM pages UNION ALL SELECT url, CASE WHEN page_id % 3 = 0 THEN html ELSE left(html, 100) END FROM pages) GROUP BY url HAVING count(*) > 1")
def f8_compare_sources(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    other = p.select("url", F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.left("html", F.lit(100))).alias("body"))
    return X.compare_sources(p.select("url", F.col("html").alias("body")).union(other), "url", "body")


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown: a heading, the whole text quoted line by line, a fenced code block, a deeper heading."""
    quoted = F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))
    md = F.concat(F.lit("# Doc "), "doc_id", F.lit("\n"), quoted, F.lit("\n```sql\n# not a heading\nSELECT "), "n_chars", F.lit(";\n```\n## Source "), "source", F.lit("\ntail"))
    return table(spark, d, "documents").select("doc_id", md.alias("md"))


@query("""SELECT doc_id AS id, s.n AS section, s.n AS level, CASE s.n WHEN 1 THEN 'Doc ' || doc_id ELSE 'Source ' || source END AS title, CASE s.n WHEN 1 THEN 'Doc ' || doc_id ELSE 'Doc ' || doc_id || ' > Source ' || source END AS breadcrumb,
md5(CASE s.n WHEN 1 THEN '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || '```sql' || chr(10) || '# not a heading' || chr(10) || 'SELECT ' || n_chars || ';' || chr(10) || '```' ELSE 'tail' END) AS content_md5 FROM documents, (VALUES (1), (2)) s(n)""")
def f9_md_sections(spark: SparkSession, d: str) -> DataFrame:
    s = X.md_sections(_markdown(spark, d), "doc_id", "md")
    return s.select("id", F.col("section").cast("int").alias("section"), "level", "title", "breadcrumb", F.md5(F.encode("content", "utf-8")).alias("content_md5"))


@query(r"""SELECT doc_id AS id, 1 AS line, 0 AS pos, false AS image, lang AS label, 'https://x.example/' || doc_id AS url FROM documents UNION ALL SELECT doc_id, 1, 1, true, '', source FROM documents""")
def f9_md_links(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents, their own brackets taken away, after a line with a link and an image; the links of code are none."""
    plain = F.translate("text", "[]()`", "")
    md = F.concat(F.lit("see ["), "lang", F.lit("](https://x.example/"), "doc_id", F.lit(") and ![]("), "source", F.lit(' "t") not `[a](b)`\n'), plain, F.lit("\n```\n[c](d)\n```\n"))
    links = X.md_links(table(spark, d, "documents").select("doc_id", md.alias("md")), "doc_id", "md")
    return links.select("id", F.col("line_no").cast("int").alias("line"), F.col("pos").cast("int").alias("pos"), "image", "label", "url")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 > 0 THEN 'Doc: ' || doc_id END AS title, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang, md5(CASE WHEN doc_id % 3 > 0 THEN text ELSE 'no front' || chr(10) || '---' || chr(10) || text END) AS body_md5 FROM documents")
def f9_md_front_matter(spark: SparkSession, d: str) -> DataFrame:
    front = F.concat(F.lit('---\ntitle: "Doc: '), "doc_id", F.lit('"\nlang: old\n# a remark\nlang:  '), "lang", F.lit(" \n---\n"), "text")
    md = F.when(F.col("doc_id") % 3 > 0, front).otherwise(F.concat(F.lit("no front\n---\n"), "text"))
    t = X.md_front_matter(table(spark, d, "documents").select("doc_id", md.alias("md")), "doc_id", "md")
    return t.select("id", F.col("fields")["title"].alias("title"), F.col("fields")["lang"].alias("lang"), F.md5(F.encode("body", "utf-8")).alias("body_md5"))


@query("SELECT doc_id AS id, 'sql' AS language, '# not a heading' || chr(10) || 'SELECT ' || n_chars || ';' AS code FROM documents")
def f9_md_code_blocks(spark: SparkSession, d: str) -> DataFrame:
    return X.md_code_blocks(_markdown(spark, d), "doc_id", "md").select("id", "language", "code")


@query("SELECT doc_id AS id, len(string_split(text, chr(10))) + 3 AS line_no, 'comment' AS rule FROM documents UNION ALL SELECT doc_id, len(string_split(text, chr(10))) + 4, 'select' FROM documents UNION ALL SELECT doc_id, len(string_split(text, chr(10))) + 4, 'seven' FROM documents WHERE contains(n_chars::VARCHAR, '7')")
def f10_audit_lines(spark: SparkSession, d: str) -> DataFrame:
    return X.audit_lines(_markdown(spark, d), {"comment": "# ", "select": "SELECT", "seven": "7"}, "doc_id", "md")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def f11_config_fields(spark: SparkSession, d: str) -> DataFrame:
    v = F.parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"))


@query("""WITH u AS (SELECT *, split_part(event_type, 'i', 1) AS c FROM events), a AS (SELECT user_id AS name, arg_max(event_id, ts) AS page FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id AS name, arg_max(event_id, ts) AS config FROM events WHERE event_type = 'click' AND user_id % 5 > 0 GROUP BY 1)
SELECT coalesce(a.name, b.name) AS name, page, config FROM a FULL JOIN b ON a.name = b.name""")
def f12_doc_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Fetches of two URL classes, told by template; the newest body of each name, joined."""
    kind = F.when(F.col("event_type") == "view", "page").when((F.col("event_type") == "click") & (F.col("user_id") % 5 > 0), "config")
    log = table(spark, d, "events").select(F.concat(F.lit("https://x.org/"), kind, F.lit("/"), "user_id", F.lit(".json")).alias("url"), "ts", "event_id").where("url is not null")
    return X.doc_catalog(log, "url", r"^https://x\.org/(\w+)/(\w+)\.json$", "ts", "event_id", ["page", "config"]).withColumn("name", F.col("name").cast("long"))


@query("""SELECT p_brand AS fn, p_type AS kind, count(*) AS n_docs, string_agg(p_size, ',' ORDER BY p_partkey) AS sizes, count(DISTINCT s.s_suppkey) > 0 AS registered FROM part LEFT JOIN supplier s ON s.s_suppkey = p_partkey GROUP BY ALL""")
def f13_signatures(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("fn"), F.col("p_type").alias("kind"), "p_size")
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"))
    return X.signatures(part, known, ["fn", "kind"], "p_partkey", "p_size").withColumnRenamed("values", "sizes")


@query("""SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path, nullif(split_part(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '/', 2), '') AS segment FROM pages""")
def f14_url_columns(spark: SparkSession, d: str) -> DataFrame:
    return X.url_columns(table(spark, d, "pages"), "url").select("page_id", "host", F.coalesce("path", F.lit("")).alias("path"), "segment")


@query(_LINKS + """, todo AS (SELECT url FROM pages UNION SELECT url FROM resolved WHERE regexp_extract(url, '^https?://([^/?#]+)', 1) = regexp_extract(base, '^https?://([^/?#]+)', 1)),
host AS (SELECT url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM todo WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)) SELECT host, url FROM host QUALIFY row_number() OVER (PARTITION BY host ORDER BY url) <= 3""")
def f15_frontier(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return X.frontier(p, p, p.where("page_id % 2 = 0"), 3)


_TOKENS = "WITH t AS (SELECT doc_id AS id, source, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '') AS t FROM documents) "
_QUERIES = [("q1", "worthless idiot clown"), ("q2", "licensed under the MIT license"), ("q3", "der und nicht"), ("q4", "heavy")]
_BM25 = _TOKENS + """, q(query, text) AS (VALUES ('q1', 'worthless idiot clown'), ('q2', 'licensed under the MIT license'), ('q3', 'der und nicht'), ('q4', 'heavy')), w AS (SELECT DISTINCT query, unnest(string_split(lower(text), ' ')) AS term FROM q),
h AS (SELECT id, len(t) AS len, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM w) GROUP BY ALL), s AS (SELECT count(*) AS n, avg(len(t)) AS avg FROM t), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
r AS (SELECT query, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS score FROM h JOIN w USING (term) JOIN f USING (term), s GROUP BY ALL)
SELECT query, id, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) <= 20"""


@query(_BM25)
def f16_bm25(spark: SparkSession, d: str) -> DataFrame:
    queries = spark.createDataFrame(_QUERIES, "query string, text string")
    return X.bm25(table(spark, d, "documents"), "doc_id", "text", queries, 20).withColumn("score", F.round("score", 6))


@query(_BM25)
def f17_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """The same search from a written index that was refreshed: at first every fifth document has another text, every seventh is missing, and others are there that are then removed."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = TextIndex(spark, scratch(spark, "index"), 8)
    stale = docs.where("doc_id % 7 > 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("heavy idiot "), "text")).otherwise(F.col("text")))
    extra = docs.select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    index.refresh(stale.unionByName(extra))
    index.refresh(docs.where("doc_id % 7 = 0 OR doc_id % 5 = 0"), extra.select("doc_id"))
    queries = spark.createDataFrame(_QUERIES, "query string, text string")
    return index.search(queries, 20).withColumn("score", F.round("score", 6))


@query(_TOKENS + """, c AS (SELECT source, term, count(*) AS tf FROM (SELECT source, unnest(t) AS term FROM t) WHERE length(term) >= 4 GROUP BY ALL), n AS (SELECT count(DISTINCT source) AS n FROM documents), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1)
SELECT source, term, tf, round(tf * ln(n / df), 6) AS score FROM c JOIN f USING (term), n QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(tf * ln(n / df), 9) DESC, term) <= 10""")
def f18_key_terms(spark: SparkSession, d: str) -> DataFrame:
    return X.key_terms(table(spark, d, "documents"), "source", "text", 10).withColumn("score", F.round("score", 6))


def _chunks(spark: SparkSession, d: str, parts: int) -> DataFrame:
    """Line items of an order as chunks of a file, the ship year as the heading."""
    from pyspark.sql import Window as W

    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    l = l.repartition(parts, "l_orderkey")
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    return l.select(F.col("l_orderkey").alias("file"), n.alias("chunk_idx"), F.concat(F.lit("Year "), F.year("l_shipdate")).alias("heading"), n.alias("page_start"), (n + 1).alias("page_end"))


_CONTENTS = """WITH c AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, 'Year ' || year(l_shipdate) AS heading FROM lineitem),
o AS (SELECT o_orderkey AS file, 1 AS ord, 'YEAR' || year(o_orderdate) AS title FROM orders WHERE o_orderkey % 10 = 0), n AS (SELECT *, lag(heading) OVER (PARTITION BY file ORDER BY i) IS DISTINCT FROM heading AS new FROM c),
m AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY i) AS ord, heading AS title FROM n WHERE new AND file NOT IN (SELECT file FROM o)), e AS (SELECT * FROM o UNION ALL SELECT * FROM m),
p AS (SELECT file, lower(replace(heading, ' ', '')) AS h, min(i) AS page_start, max(i + 1) AS page_end FROM c GROUP BY ALL), r AS (SELECT e.file, ord, title, page_start, page_end FROM e LEFT JOIN p ON p.file = e.file AND p.h = lower(replace(title, ' ', ''))) """


def _contents(spark: SparkSession, d: str, parts: int) -> DataFrame:
    outline = table(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("file"), F.lit(1).cast("long").alias("ord"), F.concat(F.lit("YEAR"), F.year("o_orderdate")).alias("title"))
    return X.contents(outline, _chunks(spark, d, parts), parts)


@query(_CONTENTS + "SELECT * FROM r")
def f19_contents(spark: SparkSession, d: str) -> DataFrame:
    return _contents(spark, d, parts_of(table(spark, d, "lineitem")))


@query(_CONTENTS + "SELECT file, string_agg('  ' || title || CASE WHEN page_start IS NULL THEN '' ELSE ' p.' || page_start || '-' || page_end END, chr(10) ORDER BY ord) AS card FROM r GROUP BY file")
def f20_digest_cards(spark: SparkSession, d: str) -> DataFrame:
    parts = parts_of(table(spark, d, "lineitem"))
    return X.digest_cards(_contents(spark, d, parts).repartition(parts, "file"))


@query("SELECT doc_id AS id, i::INT AS chunk, md5(substring(text, i::INT * 400 + 1, 500)) AS chunk_md5 FROM (SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 100) / 400)::BIGINT))) AS i FROM documents WHERE length(text) > 0)")
def f21_chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return X.chunk_text(table(spark, d, "documents"), "doc_id", "text", 500, 100).select("id", "chunk", F.md5(F.encode("chunk_text", "utf-8")).alias("chunk_md5"))


@query("""WITH s AS (SELECT doc_id AS id, s.n AS section, CASE s.n WHEN 1 THEN 'Doc ' || doc_id ELSE 'Doc ' || doc_id || ' > Source ' || source END AS breadcrumb, CASE s.n WHEN 1 THEN '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || '```sql' || chr(10) || '# not a heading' || chr(10) || 'SELECT ' || n_chars || ';' || chr(10) || '```' ELSE 'tail' END AS content FROM documents, (VALUES (1), (2)) s(n))
SELECT id, section, breadcrumb, i::INT AS chunk, md5(substring(content, i::INT * 700 + 1, 800)) AS chunk_md5 FROM (SELECT *, unnest(range(greatest(1, ceil((length(content) - 100) / 700)::BIGINT))) AS i FROM s)""")
def f21_chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of sections with the headings above them."""
    c = X.chunk_sections(_markdown(spark, d), "doc_id", "md", 800, 100)
    return c.select("id", F.col("section").cast("int").alias("section"), "breadcrumb", "chunk", F.md5(F.encode("chunk_text", "utf-8")).alias("chunk_md5"))


@query("""WITH w AS (SELECT o_custkey AS file, 1 AS page, o_orderkey % 3 AS y, o_orderkey * 1.0 AS x0, o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 5000 ELSE 0.3 END AS x1, o_orderstatus AS word FROM orders), g AS (SELECT *, lag(x1) OVER (PARTITION BY file, page, y ORDER BY x0) AS px FROM w)
SELECT file, y, string_agg(CASE WHEN px IS NULL OR x0 - px < 0.5 THEN '' ELSE ' ' END || word, '' ORDER BY x0) AS line FROM g GROUP BY ALL""")
def f22_words_to_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    words = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.lit(1).alias("page"), (k % 3).alias("y"), k.cast("double").alias("x0"), (k + F.when(k % 2 == 0, 5000.0).otherwise(0.3)).alias("x1"), F.col("o_orderstatus").alias("word"))
    return X.words_to_lines(words).select("file", "y", "line")


@query()
def f23_judge(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    empty = spark.createDataFrame([], "input_hash string")
    return X.judge(docs, empty, "is it long?", "text", "length-1", lambda t: "yes" if len(t) > 1000 else "no")


@query("""SELECT coalesce(l.doc_id, a.doc_id) AS doc_id, quality AS truth, said, CASE WHEN said IS NULL OR quality IS NULL THEN 'missing' WHEN said = quality THEN 'agree' ELSE 'disagree' END AS verdict FROM labels l
FULL JOIN (SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^a-z]', '', 'g')) / length(text) >= 0.7 THEN 1 ELSE 0 END AS said FROM documents WHERE doc_id % 4 > 0) a ON a.doc_id = l.doc_id""")
def f24_evaluate(spark: SparkSession, d: str) -> DataFrame:
    # an empty text has the share 0 / 0, which is not a number and so above any threshold (Spark raises an error instead); a null text says 0
    n, letters = F.length("text"), F.length(F.regexp_replace("text", "[^a-z]", ""))
    score = F.when(n == 0, float("nan")).when(n > 0, letters / n).otherwise(0.0)
    answers = table(spark, d, "documents").where("doc_id % 4 > 0").select("doc_id", score.alias("score"))
    return X.evaluate(answers, table(spark, d, "labels"), "doc_id", "score", "quality", 0.7)


@query("SELECT doc_id, t.term FROM documents JOIN (VALUES ('idiot'), ('clown'), ('MIT License'), ('scum'), ('worthless')) t(term) ON contains(text, term)")
def f25_term_hits(spark: SparkSession, d: str) -> DataFrame:
    terms = ["idiot", "clown", "MIT License", "scum", "worthless"]
    hits = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(t)), F.lit(t)) for t in terms]))
    return table(spark, d, "documents").select("doc_id", F.explode(hits).alias("term"))


@query("""WITH l AS (SELECT o_custkey AS file, o_orderkey AS y, CASE WHEN o_orderkey % 5 = 0 THEN 14 ELSE 9 END AS size, o_orderpriority AS line FROM orders), h AS (SELECT *, max(CASE WHEN size >= 12 THEN y END) OVER (PARTITION BY file ORDER BY y) AS title_y FROM l)
SELECT file, title_y, max(CASE WHEN size >= 12 THEN line END) AS title, coalesce(string_agg(line, ' ' ORDER BY y) FILTER (WHERE size < 12), '') AS body FROM h WHERE title_y IS NOT NULL GROUP BY ALL""")
def f26_cards(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.lit(1).alias("page"), F.lit(1).alias("col"), F.col("o_orderkey").alias("y"), F.when(F.col("o_orderkey") % 5 == 0, 14).otherwise(9).alias("size"), F.col("o_orderpriority").alias("line"))
    return X.cards(lines, 12).select("file", "title_y", "title", "body")

"""Pages, documents and text: extraction to rows, sections, search, key terms, chunks, judgments."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.operators.page_tree import Tree
from tracelake.session import cut, share_code

_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
_NODES = {"tree_id": "long", "node_id": "long", "parent_id": "long", "depth": "int", "tag": "string", "path": "string", "attrs": "map<string,string>", "text": "string", "descendants": "long"}


def _from_trees(pages: DataFrame, columns: list[Column], html_col: str, kinds: dict[str, str], take: Callable[[Tree], list[list]]) -> DataFrame:
    """Rows of every page's tree, each behind some columns of the page; a page is parsed once, by the task that reads it."""
    share_code(pages.sparkSession)
    shape = pa.schema([(name, _ARROW[kind]) for name, kind in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, html = (c.to_pylist() for c in batch.columns)
            out = [[*page, *row] for *page, text in zip(*own, html, strict=True) for row in take(Tree(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(shape)], schema=shape)

    return pages.select(*columns, F.col(html_col).alias("html")).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(tree_id, node_id, parent_id, depth, tag, path, attrs, text, descendants): the elements of every page, pre-order.

    End tags that HTML lets authors leave out are implied; text is an element's own, without that of elements in it.
    """

    def rows(tree: Tree) -> list[list]:
        return [[*r[:5], list(r[5].items()), *r[6:]] for r in tree.rows]

    return _from_trees(pages, [F.col(id_col).cast("long")], html_col, _NODES, rows)


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(tree_id, pos, node_id, kind, level, content): headings, paragraphs, code, items, cells and other text, in page order.

    The content of a block is all its text, that of inline elements too, but not that of blocks inside it.
    """
    kinds = {"tree_id": "long", "pos": "int", "node_id": "long", "kind": "string", "level": "int", "content": "string"}
    return _from_trees(pages, [F.col(id_col).cast("long")], html_col, kinds, lambda tree: [[i, *b] for i, b in enumerate(tree.blocks)])


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, pos, href, url): the anchors of a page that have a href, in page order, resolved against the page's URL.

    Attributes may be in any order and case, quoted or not; anchors in comments and scripts are none.
    """
    anchors = lambda tree: [[i, h] for i, h in enumerate(r[5]["href"].strip() for r in tree.rows if r[3] == "a" and "href" in r[5])]
    kinds = {"id": "long", "_base": "string", "pos": "int", "href": "string"}
    found = _from_trees(pages, [F.col(id_col).cast("long"), F.col(url_col)], html_col, kinds, anchors)
    return found.withColumn("url", resolve(F.col("_base"), F.col("href"))).drop("_base")


def resolve(base: Column, href: Column) -> Column:
    """An absolute URL: absolute links stay, rooted ones take the base's host, others its folder."""
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:]/)[^/]*$", "")
    return F.when(href.rlike("^[a-z]+:"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))


def page_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", comments: bool = False) -> DataFrame:
    """(id, table, row, cells): table rows of pages, natively; with comments also those hidden in HTML comments."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    html = F.regexp_replace(html, "<!--|-->", "") if comments else F.regexp_replace(html, "(?s)<!--.*?-->", "")
    t = pages.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(html, F.lit("(?s)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table", "body"))
    r = t.select("id", "table", F.posexplode(F.regexp_extract_all("body", F.lit("(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    strip = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"\s+", " "))
    return r.select("id", "table", "row", F.transform(F.regexp_extract_all("tr", F.lit("(?s)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), strip).alias("cells"))


def typed_table(rows: DataFrame, headers: Sequence[str]) -> DataFrame:
    """Table rows as columns by header name: row 0 holds the headers; a header that a table lacks gives nulls."""
    head = rows.where("row = 0").select("id", "table", F.col("cells").alias("_head"))
    at = lambda h: F.array_position("_head", h).cast("int")
    return rows.where("row > 0").join(head, ["id", "table"]).select("id", "table", "row", *[F.when(at(h) > 0, F.try_element_at("cells", at(h))).alias(h) for h in headers])


def text_at(nodes: DataFrame, prefix: str) -> DataFrame:
    """Text and attributes of the elements at or below a path."""
    return nodes.where((F.col("path") == prefix) | F.col("path").startswith(prefix + "/"))


def page_summary(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", links: int = 8) -> DataFrame:
    """Per page the raw characters, a preview and the first links."""
    first = page_links(pages, id_col, url_col, html_col).where(F.col("pos") < links).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "href"))), lambda x: x["href"]), " ").alias("first_links"))
    return pages.select(F.col(id_col).alias("id"), F.length(html_col).cast("long").alias("n_chars"), F.left(F.col(html_col), F.lit(60)).alias("preview")).join(first, "id", "left")


def compare_sources(df: DataFrame, url: str, body: str) -> DataFrame:
    """URLs fetched by several ways: how many bodies, and whether they agree."""
    return df.groupBy(url).agg(F.count("*").alias("copies"), F.countDistinct(F.md5(F.encode(body, "utf-8"))).alias("bodies")).where("copies > 1")


def md_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line, fenced, fence): Markdown lines and whether they lie in a code fence (by fence parity)."""
    t = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("p", "line")).select("id", (F.col("p") + 1).cast("long").alias("line_no"), "line")
    fence = F.col("line").startswith("```")
    before = F.coalesce(F.count_if(fence).over(W.partitionBy("id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return t.withColumns({"fence": fence, "fence_no": F.floor(before / 2) + 1, "fenced": (before % 2 == 1) & ~fence})


def md_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, level, title, breadcrumb, content): sections of Markdown by their headings outside code fences."""
    t = md_lines(docs, id_col, text_col)
    mark = F.when(~F.col("fenced"), F.regexp_extract("line", r"^(#{1,6}) ", 1)).otherwise("")
    w = W.partitionBy("id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("lvl", F.length(mark)).withColumn("section", F.count_if(F.col("lvl") > 0).over(w))
    title = F.regexp_extract("line", r"^#{1,6} (.*)$", 1)
    g = t.groupBy("id", "section").agg(F.max("lvl").alias("level"), F.max(F.when(F.col("lvl") > 0, title)).alias("title"), F.array_sort(F.collect_list(F.when(F.col("lvl") == 0, F.struct("line_no", "line")))).alias("_l"))
    up = W.partitionBy("id").orderBy("section").rowsBetween(W.unboundedPreceding, 0)
    for i in range(1, 7):  # the last title of each level, cleared by any higher heading since
        last = F.max(F.when(F.col("level") == i, F.col("section"))).over(up)
        higher = F.coalesce(F.max(F.when((F.col("level") < i) & (F.col("level") > 0), F.col("section"))).over(up), F.lit(-1))
        g = g.withColumn(f"_t{i}", F.when((last > higher) & (F.col("level") >= i), F.last(F.when(F.col("level") == i, F.col("title")), True).over(up)))
    return g.select("id", "section", "level", "title", F.concat_ws(" > ", *[f"_t{i}" for i in range(1, 7)]).alias("breadcrumb"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("content"))


def md_code_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fence_no, language, code) of fenced blocks."""
    t = md_lines(docs, id_col, text_col).where("fenced or fence")
    lang = F.max(F.when(F.col("fence"), F.regexp_extract("line", r"^```(\w*)", 1)))
    return t.groupBy("id", "fence_no").agg(lang.alias("language"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("fenced"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("code"))


def md_links(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, pos, image, label, url): inline links and images of Markdown lines outside code fences and code spans, in order."""
    t = md_lines(docs, id_col, text_col).where("not fenced and not fence")
    found = F.regexp_extract_all(F.regexp_replace("line", "`[^`]*`", ""), F.lit(r'(!?\[[^\[\]]*\]\(\s*<?[^\s()<>]+>?(?:\s+"[^"]*")?\s*\))'), F.lit(1))
    part = lambda i: F.regexp_extract("m", r'^(!?)\[([^\[\]]*)\]\(\s*<?([^\s()<>]+)', i)
    return t.select("id", "line_no", F.posexplode(found).alias("pos", "m")).select("id", "line_no", "pos", (part(1) == "!").alias("image"), part(2).alias("label"), part(3).alias("url"))


def md_front_matter(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fields, body): the `key: value` lines between a first line of three dashes and the next, as a map, and the rest of the text.

    Values lose blanks around them and one pair of quotes; of a key that is there twice the last value counts. A text
    that does not begin so has an empty map and is its own body; a null text has a null body.
    """
    head = F.regexp_extract(F.coalesce(text_col, F.lit("")), r"^---[ \t]*\r?\n((?:(?!---[ \t]*(?:\r?\n|$))[^\n]*\n)*)---[ \t]*(?:\r?\n|$)", 0)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    bare = lambda v: F.regexp_replace(F.regexp_replace(F.trim(v), r'^"(.*)"$', "$1"), r"^'(.*)'$", "$1")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("key"), bare(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    # the last of a key: what comes later is met first
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return docs.select(F.col(id_col).alias("id"), F.map_from_entries(kept).alias("fields"), F.substr(F.col(text_col), F.length(head) + 1).alias("body"))


def audit_lines(docs: DataFrame, needles: dict[str, str], id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, rule) of code lines that hold a rule's needle."""
    hits = F.array_compact(F.array(*[F.when(F.contains("line", F.lit(n)), F.lit(k)) for k, n in needles.items()]))
    return md_lines(docs, id_col, text_col).where("fenced").select("id", "line_no", F.explode(hits).alias("rule"))


def url_columns(df: DataFrame, url: str) -> DataFrame:
    """df with host, path, query, first path segment and a normalised form of its URLs; bad URLs give nulls."""
    part = lambda p: F.try_parse_url(F.col(url), F.lit(p))
    path = part("PATH")
    return df.withColumns({"host": F.lower(part("HOST")), "path": path, "query": part("QUERY"), "segment": F.nullif(F.split_part(path, F.lit("/"), F.lit(2)), F.lit("")), "normal": F.concat(F.lower(part("HOST")), F.regexp_replace(path, "/+$", ""))})


def frontier(log: DataFrame, seeds: DataFrame, recent: DataFrame, per_host: int) -> DataFrame:
    """(host, url): seeds and same-host links of landed pages that were not fetched lately, so many a host."""
    links = page_links(log).join(log.select(F.col("page_id").alias("id"), F.col("url").alias("_from")), "id")
    host = lambda c: F.try_parse_url(F.col(c), F.lit("HOST"))
    same = links.where(host("url") == host("_from")).select("url")
    todo = seeds.select("url").union(same).distinct().join(recent.select("url").distinct(), "url", "left_anti").withColumn("host", host("url"))
    return todo.withColumn("_r", F.row_number().over(W.partitionBy("host").orderBy("url"))).where(F.col("_r") <= per_host).select("host", "url")


def doc_catalog(log: DataFrame, url: str, pattern: str, ts: str, value: str, classes: Sequence[str]) -> DataFrame:
    """(name, a column a class): the newest value of every name and URL class; pattern: groups of class and name, other URLs are left out."""
    told = log.select(F.regexp_extract(url, pattern, 1).alias("_c"), F.regexp_extract(url, pattern, 2).alias("name"), F.col(ts).alias("_t"), F.col(value).alias("_v")).where("name <> ''")
    return told.groupBy("name").agg(*[F.max_by(F.when(F.col("_c") == c, F.col("_v")), F.when(F.col("_c") == c, F.col("_t"))).alias(c) for c in classes]).where(" OR ".join(f"`{c}` IS NOT NULL" for c in classes))


def signatures(docs: DataFrame, registry: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """(keys, n_docs, values, registered): documented signatures with their values in order, and whether any of them is in the registry (order)."""
    j = docs.join(registry.select(order).distinct().withColumn("_there", F.lit(1)), order, "left")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("string")), ",")
    return j.groupBy(*keys).agg(F.count("*").alias("n_docs"), listed.alias("values"), (F.count("_there") > 0).alias("registered"))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), "")


def _ends(s: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Where runs of like elements of an array that isn't empty end, after a zero."""
    return F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | ~same(F.get(s, i - 1), F.get(s, i)))


def _runs_of(s: Column, same: Callable[[Column, Column], Column], made: Callable[[Column, Column], Column]) -> Column:
    """made(begin, end) of every run of like elements of an array that isn't empty; s is to be cheap to name, as a lambda's variable is."""
    runs = lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda j: made(F.get(e, j - 1), F.get(e, j)))
    return F.flatten(F.transform(F.array(_ends(s, same)), runs))


def postings(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(id, n_terms, bucket, terms, tfs): of each row of docs, by bucket of terms, its terms, joined by spaces, and how often each is there; nothing is shuffled."""
    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    sort = F.sort_array(F.transform("t", lambda x: F.struct(F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int").alias("b"), x.alias("x"))))
    count = lambda s: _runs_of(s, lambda x, y: x["x"] == y["x"], lambda i, j: F.struct(F.get(s, i)["b"].alias("b"), F.get(s, i)["x"].alias("x"), (j - i).alias("tf")))
    deal = lambda s: _runs_of(s, lambda x, y: x["b"] == y["b"], lambda i, j: F.struct(F.get(s, i)["b"].alias("bucket"), F.array_join(F.slice(s["x"], i + 1, j - i), " ").alias("terms"), F.slice(s["tf"], i + 1, j - i).alias("tfs")))
    dealt = F.flatten(F.transform(F.transform(F.array(sort), count), deal))  # the arrays hold the one list
    return t.select("id", F.size("t").alias("n_terms"), F.inline(dealt))


def bm25(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, id, score): the k best documents of every query by BM25; queries: (query, text).

    Only the query's terms are exploded from a text, so no full index is shuffled. Counts cover all documents.
    """
    wanted = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    terms = wanted.select("term").distinct().agg(F.collect_list("term").alias("_terms"))
    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t")).crossJoin(F.broadcast(terms))  # one row
    held = F.when(F.arrays_overlap("t", "_terms"), F.filter("t", lambda x: F.array_contains("_terms", x)))
    # one row a document: every text is split once
    slim = cut(t.select("id", F.size("t").alias("len"), held.alias("held")))
    stats = slim.agg(F.count("*").alias("_n"), F.avg("len").alias("_avg"))
    hits = slim.where("held is not null").select("id", "len", F.explode("held").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    return rank_bm25(hits, stats, wanted, k, k1, b)


def rank_bm25(hits: DataFrame, stats: DataFrame, wanted: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """hits: (id, len, term, tf) of the wanted terms; wanted: (query, term); stats: one row of _n and _avg."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = wanted.join(df, "term").crossJoin(F.broadcast(stats)).select("query", "term", "_avg", idf.alias("idf"))  # one row
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("_avg")))
    scores = hits.join(weighed, "term").groupBy("query", "id").agg(F.sum(part).alias("score"))
    return scores.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))).where(F.col("_r") <= k).drop("_r")


def key_terms(docs: DataFrame, section: str, text_col: str, k: int, min_chars: int = 4) -> DataFrame:
    """(section, term, tf, score): the k terms of each section with the highest tf-idf, sections being the documents."""
    t = docs.select(section, F.explode_outer(F.filter(tokens(F.col(text_col)), lambda x: F.length(x) >= min_chars)).alias("term")).where("term is not null").groupBy(section, "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.countDistinct(section).alias("_n"))
    df = t.groupBy("term").agg(F.count("*").alias("_df"))
    s = t.join(df, "term").crossJoin(F.broadcast(n)).withColumn("score", F.col("tf") * F.ln(F.col("_n") / F.col("_df")))  # one row
    return s.withColumn("_r", F.row_number().over(W.partitionBy(section).orderBy(F.desc(F.round("score", 9)), "term"))).where(F.col("_r") <= k).select(section, "term", "tf", "score")


def contents(outline: DataFrame, chunks: DataFrame, parts: int | None = None) -> DataFrame:
    """(file, ord, title, page_start, page_end): declared outlines, else heading changes between a file's chunks.

    parts: partitions for the join of titles with pages; if not given, as many as the session takes.
    """
    w = W.partitionBy("file").orderBy("chunk_idx")
    told = chunks.withColumn("_new", ~F.lag("heading").over(w).eqNullSafe(F.col("heading"))).where("_new and heading is not null")
    made = told.join(outline.select("file").distinct(), "file", "left_anti").select("file", F.row_number().over(W.partitionBy("file").orderBy("chunk_idx")).cast("long").alias("ord"), F.col("heading").alias("title"))
    every = outline.select("file", "ord", "title").unionByName(made)
    flat = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("")))
    pages = chunks.where("heading is not null").groupBy("file", flat("heading").alias("_h")).agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
    every = every.withColumn("_h", flat("title"))
    if parts:
        every, pages = (x.repartition(parts, "file", "_h") for x in (every, pages))
    return every.join(pages, ["file", "_h"], "left").drop("_h")


def digest_cards(parts: DataFrame) -> DataFrame:
    """(file, card): one text a file, its contents in order, with their pages."""
    line = F.concat(F.lit("  "), "title", F.when(F.col("page_start").isNotNull(), F.concat(F.lit(" p."), "page_start", F.lit("-"), "page_end")).otherwise(""))
    return parts.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("card"))


def chunk_text(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int, carry: Sequence[str] = ()) -> DataFrame:
    """(id, carry, chunk, chunk_text): pieces of size characters, each beginning overlap before the last one's end.

    carry: columns that every piece of a row keeps, as the headings above it. A piece is cut in time of its own length:
    in four bytes a character it is found without counting from the start. Null and empty texts have no pieces.
    """
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text_col) - overlap) / F.lit(step))).cast("int")
    piece = lambda b: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.decode(F.substring(b, 4 * i * step + 1, F.lit(4 * size)), "UTF-32"))
    pieces = F.flatten(F.transform(F.array(F.encode(text_col, "UTF-32")), piece))  # the array holds the one text
    return df.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), *carry, F.posexplode(pieces).alias("chunk", "chunk_text"))


def chunk_sections(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """(id, section, breadcrumb, chunk, chunk_text): pieces of the sections of Markdown, each with the headings above it; no piece reaches over a heading."""
    return chunk_text(md_sections(docs, id_col, text_col), "id", "content", size, overlap, ["section", "breadcrumb"])


def words_to_lines(words: DataFrame, gap: float = 0.5) -> DataFrame:
    """(file, page, y, line): words on one height in order of x; runs closer than gap are glued."""
    w = W.partitionBy("file", "page", "y").orderBy("x0")
    glue = (F.col("x0") - F.lag("x1").over(w)) < gap
    t = words.withColumn("_part", F.concat(F.when(F.coalesce(glue, F.lit(False)) | F.lag("x1").over(w).isNull(), "").otherwise(" "), "word"))
    return t.groupBy("file", "page", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "_part"))), lambda x: x["_part"]), "").alias("line"))


def judge(df: DataFrame, store: DataFrame, question: str, text_col: str, model: str, predict: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """(input_hash, answer, error): answers for texts that the store lacks, each distinct text asked once; failures stay."""
    share_code(df.sparkSession)
    key = F.sha2(F.to_json(F.struct(F.lit(question).alias("q"), F.lit(model).alias("m"), F.col(text_col).alias("t"))), 256)
    todo = df.select(key.alias("input_hash"), F.col(text_col).alias("t")).dropDuplicates(["input_hash"]).join(store.select("input_hash"), "input_hash", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            answers, errors = [], []
            for t in pdf["t"]:
                try:
                    answers.append(str(predict(t)))
                    errors.append(None)
                except Exception as e:  # a failed judgment is a row, not a failed job
                    answers.append(None)
                    errors.append(repr(e))
            yield pd.DataFrame({"input_hash": pdf["input_hash"], "answer": answers, "error": errors})

    return todo.mapInPandas(run, "input_hash string, answer string, error string")


def evaluate(answers: DataFrame, labels: DataFrame, key: str, score: str, label: str, threshold: float) -> DataFrame:
    """Every labelled or answered row with truth, prediction and verdict: agree, disagree or missing."""
    j = labels.select(key, F.col(label).alias("truth")).join(answers.select(key, (F.col(score) >= threshold).cast("int").alias("said")), key, "full_outer")
    return j.withColumn("verdict", F.when(F.col("said").isNull() | F.col("truth").isNull(), "missing").when(F.col("said") == F.col("truth"), "agree").otherwise("disagree"))


def cards(lines: DataFrame, heading_size: float) -> DataFrame:
    """(file, page, col, title_y, title, body): a line of heading size starts a card; lines below it belong to it."""
    w = W.partitionBy("file", "page", "col").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    head = F.when(F.col("size") >= heading_size, F.struct("y", "line"))
    t = lines.withColumn("_h", F.last(head, True).over(w)).where("_h is not null")
    return t.groupBy("file", "page", "col", F.col("_h.y").alias("title_y"), F.col("_h.line").alias("title")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("size") < heading_size, F.struct("y", "line")))), lambda x: x["line"]), " ").alias("body"))

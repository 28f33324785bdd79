"""Versions of file and row tables: summaries, histories, differences and audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.operators.relational import range_join


def path_history(tree: DataFrame, log: DataFrame, path: str, last: int) -> DataFrame:
    """A path in each of the last versions of log (version, ts), of equal times the greater version; versions without it give no row."""
    recent = log.orderBy(F.desc("ts"), F.desc("version")).limit(last)
    return tree.where(F.col("path") == path).join(F.broadcast(recent), "version")  # last rows


def read_versions(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """A dataset as it stands in the folders of several versions, as one relation with the column version; columns that a version lacks are null in it."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p).withColumn("version", F.lit(v).cast("long")) for v, p in sorted(paths.items())])


def distinct_contents(history: DataFrame, key: Sequence[str], blob: str, version: str) -> DataFrame:
    """The versions that hold each content of a path."""
    return history.groupBy(*key, blob).agg(F.array_join(F.transform(F.array_sort(F.collect_list(version)), lambda x: x.cast("string")), ",").alias("versions"), F.count("*").alias("n"))


def diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of either side with what happened to it and which columns changed; keys are unique on both sides."""
    columns = [c for c in before.columns if c not in keys]
    b = before.select(*keys, F.struct(*columns).alias("_b"))
    a = after.select(*keys, F.struct(*columns).alias("_a"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_b.{c}").eqNullSafe(F.col(f"_a.{c}")), F.lit(c)) for c in columns]))
    j = b.join(a, list(keys), "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_b").eqNullSafe(F.col("_a")), "unchanged").otherwise("modified")
    return j.select(*keys, change.alias("change"), F.when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), F.array_join(changed, ",")).otherwise("").alias("columns"))


def drop_wrappers(nodes: DataFrame) -> DataFrame:
    """Nodes less those with a child of the same tag."""
    child = nodes.select("tree_id", F.col("parent_id").alias("node_id"), "tag")
    return nodes.join(child, ["tree_id", "node_id", "tag"], "left_anti")


def added_lines(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, copy): lines of after without a match in before, the k-th copy being matched to the k-th."""

    def numbered(df: DataFrame) -> DataFrame:
        t = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        return t.withColumn("copy", F.row_number().over(W.partitionBy(key, "line").orderBy("pos"))).select(key, "line", "copy")

    return numbered(after).join(numbered(before), [key, "line", "copy"], "left_anti")


def span_authors(spans: DataFrame, authors: DataFrame, file: str, width: int = 1024) -> DataFrame:
    """spans (file, start, end) with the authors of their lines; spans without any have none. Lines meet spans of their own file by bins of width lines."""
    held = range_join(authors.select(file, "line", "author"), spans.select(file, "start", "end", (F.col("end") + 1).alias("_after")).distinct(), "line", "start", "_after", width, [file])
    by = held.groupBy(file, "start", "end").agg(F.array_join(F.array_sort(F.collect_set(F.col("author").cast("string"))), ",").alias("authors"))
    return spans.select(file, "start", "end").distinct().join(by, [file, "start", "end"], "left").withColumn("authors", F.coalesce("authors", F.lit("")))


def files_containing(texts: DataFrame, messages: DataFrame, id_col: str, text_col: str, message_id: str, message: str, words: int = 3, block: int = 200) -> DataFrame:
    """(id, message_id) where a text holds a whole message; ids are unique.

    Texts meet messages by the message's first inner words, an equi-join on the texts' word runs that carries ids
    alone; the pairs then meet their texts again and are searched. Messages of up to words + 2 words have no inner run
    to meet by: they are looked for in every text, in blocks of block messages and a scan each.
    """
    split = lambda c: F.split(F.col(c), " ")
    short = messages.where(F.col(message).isNotNull() & (F.size(split(message)) <= words + 2)).select(F.col(message_id).alias("i"), F.col(message).alias("m")).distinct()
    kind = messages.schema[message_id].dataType
    found, n = [], -(-short.count() // block)
    for b in range(n):
        part = short.where(F.pmod(F.xxhash64("i", "m"), F.lit(n)) == b).collect()
        if part:
            wanted = F.array(*[F.struct(F.lit(r["i"]).cast(kind).alias("i"), F.lit(r["m"]).alias("m")) for r in part])
            found.append(texts.select(F.col(id_col).alias("id"), F.explode(F.filter(wanted, lambda x: F.contains(F.col(text_col), x["m"]))).alias("x")).select("id", F.col("x.i").alias("message_id")))
    keyed = messages.select(F.col(message_id).alias("message_id"), F.col(message).alias("_m"), F.xxhash64(F.array_join(F.slice(split(message), 2, words), " ")).alias("_key")).where(F.size(F.split("_m", " ")) > words + 2)
    t = texts.select(F.col(id_col).alias("id"), split(text_col).alias("_w"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - words + 1)), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, words), " ")))
    met = t.select("id", F.explode_outer(F.array_distinct(runs)).alias("_key")).join(keyed, "_key").select("id", "message_id", "_m").distinct()
    bodies = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"))
    return reduce(DataFrame.unionByName, found, met.join(bodies, "id").where(F.contains("_t", F.col("_m"))).select("id", "message_id"))


def audit_results(stored: DataFrame, again: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Stored results that differ from a new computation, or that only one side has."""
    j = stored.select(*keys, F.col(value).alias("stored"), F.lit(1).alias("_s")).join(again.select(*keys, F.col(value).alias("again"), F.lit(1).alias("_n")), list(keys), "full_outer")
    return j.where(~F.col("stored").eqNullSafe(F.col("again")) | F.col("_s").isNull() | F.col("_n").isNull()).drop("_s", "_n")


def compare_sides(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, left, right, verdict): every input with what two implementations made of it: agree, differ, left only or right only.

    Keys are unique on each side; null values agree with each other; keys that are null meet no one.
    """
    j = left.select(*keys, F.col(value).alias("left"), F.lit(1).alias("_l")).join(right.select(*keys, F.col(value).alias("right"), F.lit(1).alias("_r")), list(keys), "full_outer")
    verdict = F.when(F.col("_l").isNull(), "right only").when(F.col("_r").isNull(), "left only").when(F.col("left").eqNullSafe(F.col("right")), "agree").otherwise("differ")
    return j.withColumn("verdict", verdict).drop("_l", "_r")


def status(current: DataFrame, recorded: DataFrame, path: str, blob: str) -> DataFrame:
    """Paths that are new, changed or gone against what was recorded."""
    j = current.select(path, F.col(blob).alias("_c")).join(recorded.select(path, F.col(blob).alias("_r")), path, "full_outer")
    s = F.when(F.col("_r").isNull(), "new").when(F.col("_c").isNull(), "gone").when(F.col("_c") != F.col("_r"), "changed")
    return j.select(path, s.alias("status")).where("status is not null")


def find_definitions(nodes: DataFrame, tags: Sequence[str]) -> DataFrame:
    """(tree_id, tag, node_id, last_id): where wanted elements are, with the span of nodes below them."""
    return nodes.where(F.col("tag").isin(*tags)).select("tree_id", "tag", "node_id", (F.col("node_id") + F.col("descendants")).alias("last_id"))


def call_sites(nodes: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Per wanted element the trees that hold it and how often."""
    return nodes.where(F.col("tag").isin(*tags)).groupBy("tag").agg(F.countDistinct("tree_id").alias("trees"), F.count("*").alias("n"), F.max("depth").alias("deepest"))

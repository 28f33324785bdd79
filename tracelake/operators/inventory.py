"""Inventories, snapshots, reports and graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.session import cut


def exclude_paths(paths: DataFrame, rules: DataFrame, path: str) -> DataFrame:
    """paths with the topmost excluded segment: cut_at and reason; rules: (segment, first_only, reason)."""
    seg = paths.select(path, F.posexplode(F.split(path, "/")).alias("i", "segment")).join(rules, "segment").where(~F.col("first_only") | (F.col("i") == 0))
    hit = seg.groupBy(path).agg(F.min("i").alias("cut_at"), F.min_by("reason", "i").alias("reason"))
    return paths.join(hit, path, "left")


def worklist(stored: DataFrame, present: DataFrame, key: str, mark: str) -> DataFrame:
    """What to do for each key: list what is new, walk what changed, drop what is gone; what agrees is left out."""
    j = stored.select(key, F.col(mark).alias("_s")).join(present.select(key, F.col(mark).alias("_p")), key, "full_outer")
    todo = F.when(F.col("_s").isNull(), "list").when(F.col("_p").isNull(), "gone").when(F.col("_s") != F.col("_p"), "walk")
    return j.select(key, todo.alias("todo")).where("todo is not null")


def path_columns(df: DataFrame, path: str) -> DataFrame:
    """df with folder, name, stem and extension of a path."""
    p = F.col(path)
    name = F.element_at(F.split(p, "/"), -1)
    return df.withColumns({"folder": F.regexp_replace(p, "/?[^/]*$", ""), "name": name, "stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "extension": F.nullif(F.regexp_extract(name, r".\.([^.]*)$", 1), F.lit(""))})


def folder_sizes(files: DataFrame, path: str, size: str) -> DataFrame:
    """(folder, n, bytes): every folder with what lies in it and below."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.where(F.size(parts) > 1).select(F.explode(folders).alias("folder"), size).groupBy("folder").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def parse_elapsed(text: Column) -> Column:
    """Seconds of ``[[dd-]hh:]mm:ss``; null for anything else."""
    p = r"^(?:(?:(\d+)-)?(\d+):)?(\d+):(\d+)$"
    n = lambda i: F.coalesce(F.regexp_extract(text, p, i).try_cast("long"), F.lit(0))
    return F.when(text.rlike(p), n(1) * 86400 + n(2) * 3600 + n(3) * 60 + n(4))


def parse_size(text: Column) -> Column:
    """Bytes of ``12K``, ``1.5M``, ``2G`` or a plain number; null for anything else."""
    p = r"^([0-9.]+)([KMGT]?)[+-]?$"
    unit = F.create_map(*[F.lit(x) for i, u in enumerate(["", "K", "M", "G", "T"]) for x in (u, float(1024**i))])
    return F.when(text.rlike(p), (F.regexp_extract(text, p, 1).try_cast("double") * F.try_element_at(unit, F.regexp_extract(text, p, 2))).cast("long"))


def process_groups(snapshot: DataFrame) -> DataFrame:
    """snapshot (pid, ppid, pgid, elapsed, exe) with the parent's and the group leader's exe and the group's oldest pid."""
    name = snapshot.select(F.col("pid").alias("_p"), F.col("exe").alias("_e"))
    t = snapshot.join(name.toDF("ppid", "parent_exe"), "ppid", "left").join(name.toDF("pgid", "leader_exe"), "pgid", "left")
    w = W.partitionBy("pgid")
    return t.withColumns({"root_pid": F.max_by("pid", F.struct("elapsed", -F.col("pid"))).over(w), "group_age": F.max("elapsed").over(w)})


def kv_reports(lines: DataFrame, keys: Sequence[str], content: str, order: str) -> DataFrame:
    """``key: value`` lines as a map a report; the first of a repeated key counts."""
    at = F.instr(content, ":")
    kv = lines.where(at > 0).select(*keys, F.trim(F.substring(F.col(content), F.lit(1), at - 1)).alias("_k"), F.trim(F.substring(F.col(content), at + 1, F.length(content))).alias("_v"), order)
    first = kv.groupBy(*keys, "_k").agg(F.min_by("_v", order).alias("_v"))
    return first.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("fields"))


def json_reports(files: DataFrame, key: str, content: str, item_schema: str) -> DataFrame:
    """Reports of a JSON header line and a JSON body with items: a row an item with the header's name."""
    head, body = F.substring_index(content, "\n", 1), F.substring(F.col(content), F.instr(content, "\n") + 1, F.length(content))
    t = files.select(key, F.try_variant_get(F.try_parse_json(head), "$.name", "string").alias("name"), F.from_json(body, f"items array<struct<{item_schema}>>").alias("_b"))
    return t.select(key, "name", F.explode("_b.items").alias("_i")).select(key, "name", "_i.*")


def query_metrics(log: DataFrame, keys: Sequence[str], metric: str, value: str, wanted: dict[str, str]) -> DataFrame:
    """Metric rows folded to a row a query, typed; a value that does not cast is null."""
    return log.groupBy(*keys).agg(*[F.max(F.when(F.col(metric) == m, F.col(value).try_cast(t))).alias(m) for m, t in wanted.items()])


def profile_share(nodes: DataFrame, query: str, kind: str, seconds: str, hot: float) -> DataFrame:
    """Time of each operator type in its query, its share and whether it is hot."""
    g = nodes.groupBy(query, kind).agg(F.sum(seconds).alias("seconds"))
    share = F.try_divide(F.col("seconds"), F.sum("seconds").over(W.partitionBy(query)))
    return g.withColumn("share", share).withColumn("hot", F.col("share") >= hot)


def graph_views(nodes: Sequence[tuple[DataFrame, str, str, str]], edges: Sequence[tuple[DataFrame, str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(node, edge) tables from entity tables: (df, label, id, name) and (df, label, source id, target id), ids as text."""
    n = [df.select(F.concat(F.lit(f"{label}:"), i).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name")) for df, label, i, name in nodes]
    e = [df.select(F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.lit(label).alias("label")) for df, label, src, dst in edges]
    first = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(first(parts[1:]))
    return first(n), first(e)


def hops(edges: DataFrame, start: DataFrame, k: int) -> DataFrame:
    """(node, hop): nodes within k hops of the start nodes (node), each with its least hop."""
    seen = cut(start.select("node", F.lit(0).alias("hop")).distinct())
    front = seen
    for h in range(1, k + 1):
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(h)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def staleness(log: DataFrame, table: str, status: str, finished: str, now: Column) -> DataFrame:
    """Per table its last good pull and the seconds since."""
    ok = F.max(F.when(F.col(status) == "ok", F.col(finished)))
    t = log.groupBy(table).agg(ok.alias("last_ok"), F.max_by(status, finished).alias("last_status"))
    return t.withColumn("stale_seconds", F.unix_seconds(now) - F.unix_seconds(F.col("last_ok").cast("timestamp")))

"""Log and CI analytics over landed lines, results and runs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.operators.relational import newest_per_key

_NAMED = re.compile(r"\(\?P<(\w+)>")


def parse_log(lines: DataFrame, pattern: str, content: str = "content", marker: str | None = None) -> DataFrame:
    """lines that match a pattern with named groups, with a column a group; a literal marker is looked for first.

    The marker is a cheap test that spares most lines the pattern; it must be part of every line that matches.
    """
    names = _NAMED.findall(pattern)
    java = _NAMED.sub("(", pattern)
    groups, depth = {}, 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]])*\]|\((\?P<\w+>|\?)?", pattern):
        if m[0].startswith("(") and m[1] != "?":
            depth += 1
            if m[1]:
                groups[m[1][3:-1]] = depth
    kept = lines.where(F.col(content).contains(marker)) if marker else lines
    kept = kept.where(F.col(content).rlike(java))
    return kept.select("*", *[F.regexp_extract(content, java, groups[n]).alias(n) for n in names])


def with_context(lines: DataFrame, keys: Sequence[str], order: str, content: str, event: Column, n: int) -> DataFrame:
    """Event lines with the n lines before and after them, as (line, content) in order."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-n, n)
    around = F.array_sort(F.collect_list(F.struct(F.col(order).alias("line"), F.col(content).alias("content"))).over(w))
    return lines.withColumn("_event", event).withColumn("context", around).where("_event").drop("_event")


def gaps(results: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str] = ()) -> DataFrame:
    """results with gap_ms, the time since the one before on the same worker; the first has none."""
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    return results.withColumn("gap_ms", ms - F.lag(ms).over(W.partitionBy(*keys).orderBy(ts, *order)))


def spans(steps: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """steps numbered, each with the time at which the next one starts."""
    w = W.partitionBy(*keys).orderBy(ts)
    return steps.withColumns({"number": F.row_number().over(w).cast("long"), "ends": F.lead(ts).over(w)})


def phase_map(text: Column, item: str = ", ", pair: str = "=") -> Column:
    """``a=1.5, b=2`` as a map of seconds."""
    parts = F.filter(F.split(text, item), lambda x: F.contains(x, F.lit(pair)))
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit(pair), F.lit(1)), F.split_part(x, F.lit(pair), F.lit(2)).try_cast("double"))))


def fingerprint(message: Column) -> Column:
    """A stable hash of a message without its hexadecimal numbers, numbers and quoted parts."""
    plain = F.regexp_replace(F.regexp_replace(message, "0x[0-9a-fA-F]+", "<hex>"), "[0-9]+(\\.[0-9]+)?", "<n>")
    return F.md5(F.encode(F.regexp_replace(plain, "'[^']*'", "<s>"), "utf-8"))


def clusters(errors: DataFrame, by: str, job: str, at_least: int = 1) -> DataFrame:
    """Errors by fingerprint or finding: in how many jobs, in which, how often."""
    g = errors.groupBy(by).agg(F.countDistinct(job).alias("n_jobs"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set(job)), lambda x: x.cast("string")), ",").alias("jobs"))
    return g.where(F.col("n_jobs") >= at_least)


#: Tool, marker and pattern of failure lines.
FAILURE_PATTERNS: list[tuple[str, str, str]] = [
    ("pytest", "FAILED ", r"FAILED (\S+?)::(\S+)"),
    ("make", "*** [", r"\*\*\* \[(?:(\S+):\d+: )?(\S+)\] Error"),
    ("gcc", ": error:", r"^(\S+?):\d+:\d+: error: (.*)$"),
    ("ctest", "***Failed", r"Test\s+#(\d+): (\S+) .*\*\*\*Failed"),
    ("format", "would reformat ", r"(would) reformat (\S+)"),
]


def failures(lines: DataFrame, content: str = "content", patterns: Sequence[tuple[str, str, str]] = FAILURE_PATTERNS) -> DataFrame:
    """Lines that a failure pattern reads, with (tool, where, what); one pass for all patterns, a row a pattern that reads."""
    c = F.col(content)
    found = [F.when(c.contains(marker) & c.rlike(p), F.struct(F.lit(tool).alias("tool"), F.regexp_extract(c, p, 1).alias("where"), F.regexp_extract(c, p, 2).alias("what"))) for tool, marker, p in patterns]
    return lines.select("*", F.explode(F.array_compact(F.array(*found))).alias("_f")).select(*lines.columns, "_f.*")


def coverage_by_file(files: DataFrame, results: DataFrame, key: str, seconds: str) -> DataFrame:
    """Every file with the runs, failures and seconds of its tests; files that never ran have none."""
    g = results.groupBy(key).agg(F.count("*").alias("runs"), F.count_if(F.col("failed")).alias("failures"), F.round(F.sum(seconds), 2).alias("seconds"))
    return files.join(g, key, "left").select(key, F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("failures", F.lit(0)).alias("failures"), "seconds")


def plateaus(results: DataFrame, gap: str, within_ms: int = 150) -> DataFrame:
    """Gaps within so many milliseconds of a whole number of seconds, by that number."""
    whole = F.floor((F.col(gap) + 500) / 1000)
    near = F.abs(F.col(gap) - whole * 1000) <= within_ms
    return results.where(F.col(gap).isNotNull() & near & (whole > 0)).groupBy(whole.alias("seconds")).agg(F.count("*").alias("n"))


def flaky(results: DataFrame, test: str, outcome: str) -> DataFrame:
    """Tests that had more than one outcome."""
    return results.groupBy(test).agg(F.count("*").alias("runs"), F.array_join(F.array_sort(F.collect_set(outcome)), ",").alias("outcomes"), F.countDistinct(outcome).alias("kinds")).where("kinds > 1").drop("kinds")


def exploded_api(pages: DataFrame, schema: str, body: str, items: str) -> DataFrame:
    """Rows of a JSON body's list: the columns of the page and those of the items, and each item whole as JSON (raw), with the fields that schema does not name.

    A page whose list is empty or missing is kept as one row without an item.
    """
    parsed = pages.withColumn("_p", F.from_json(body, schema)).withColumn("_raw", F.from_json(F.get_json_object(body, f"$.{items}"), "array<string>"))
    whole = F.explode_outer(F.when(F.size(f"_p.{items}") > 0, F.arrays_zip(F.col(f"_p.{items}").alias("i"), F.col("_raw").alias("r")))).alias("_x")
    return parsed.select(*pages.columns, whole).select(*[c for c in pages.columns if c != body], "_x.i.*", F.col("_x.r").alias("raw"))


def api_levels(pages: DataFrame, body: str, levels: Sequence[tuple[str, str]], key: str, fetched: str) -> DataFrame:
    """Rows of the innermost level of nested JSON lists, as runs, their jobs and their steps, with the columns of all levels around it.

    levels: of each level the name of its list and its columns ("id bigint, name string"), which come back as list_column.
    Of the items of the first level that have the same key, the copy of the page that was fetched last is taken. An item
    whose list is empty or missing is one row with nulls for the levels below; a page without items gives no row.
    """
    rows = pages.select(F.col(fetched).alias("_fetched"), F.col(body).alias("raw"))
    for i, (name, columns) in enumerate(levels):
        before = rows.columns
        rows = exploded_api(rows, f"{name} array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in columns.split(','))}>>", "raw", name)
        own = [c for c in rows.columns if c not in before and c != "raw"]
        rows = rows.withColumnsRenamed({c: f"{name}_{c}" for c in own})
        if i == 0:
            first = f"{name}_{key}"
            rows = newest_per_key(rows.where(F.col(first).isNotNull()), [first], ["_fetched", "raw"])
    return rows.drop("_fetched", "raw")


def timed(jobs: DataFrame, started: str, ended: str, status: str, conclusion: str) -> DataFrame:
    """Completed, unskipped jobs with whole, unnegative seconds."""
    seconds = F.unix_seconds(F.col(ended).cast("timestamp")) - F.unix_seconds(F.col(started).cast("timestamp"))
    return jobs.where((F.col(status) == "completed") & ~F.coalesce(F.col(conclusion), F.lit("")).isin("skipped", "")).withColumn("seconds", seconds).where("seconds >= 0")


def long_pole(jobs: DataFrame, name: str, seconds: str) -> DataFrame:
    """Per job name: runs, the lower median and the worst. The median is found by rank, so a name may have any number of runs."""
    ranked = jobs.select(name, seconds).where(F.col(seconds).isNotNull()).withColumns({"_r": F.row_number().over(W.partitionBy(name).orderBy(seconds)), "_n": F.count("*").over(W.partitionBy(name))})
    return ranked.groupBy(name).agg(F.max("_n").alias("n"), F.max(F.when(F.col("_r") == F.floor((F.col("_n") + 1) / 2), F.col(seconds))).alias("lower_median"), F.max(seconds).alias("worst"))


def gantt(jobs: DataFrame, run: str, started: str) -> DataFrame:
    """jobs with the milliseconds from their run's first start."""
    ms = F.unix_millis(F.col(started).cast("timestamp"))
    return jobs.withColumn("offset_ms", ms - F.min(ms).over(W.partitionBy(run)))


def gate_split(files: DataFrame, run: str, path: str, sides: dict[str, str]) -> DataFrame:
    """Files of a run by side, told by path prefix; a side with none has an empty list."""
    side = lambda p: F.array_sort(F.collect_list(F.when(F.col(path).startswith(p), F.col(path))))
    return files.groupBy(run).agg(*[side(p).alias(k) for k, p in sides.items()])


def shard_balance(results: DataFrame, keys: Sequence[str], ts: str, gap: str) -> DataFrame:
    """Per shard the wall span, the summed work and the slowest test; the ratio of the slowest to the fastest shard."""
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    g = results.groupBy(*keys).agg((F.max(ms) - F.min(ms)).alias("wall_ms"), F.sum(gap).alias("work_ms"), F.max(gap).alias("slowest_ms"))
    w = W.partitionBy(*keys[:-1])
    return g.withColumn("ratio", F.round(F.try_divide(F.max("wall_ms").over(w), F.min("wall_ms").over(w)), 4))


def typical(runs: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The run of each key whose value is nearest to the median."""
    mid = runs.groupBy(*keys).agg(F.median(value).alias("_mid"))
    away = F.abs(F.col(value) - F.col("_mid"))
    return runs.join(mid, list(keys)).groupBy(*keys).agg(F.min_by(F.struct(order, value), F.struct(away, F.col(order))).alias("_r")).select(*keys, "_r.*")


def series_split(df: DataFrame, keys: Sequence[str], ts: str, cut_at: Column, value: str) -> DataFrame:
    """(keys, series, n, mean): a value before and after a cut time; rows at the cut count as after."""
    return df.groupBy(*keys, F.when(F.col(ts) >= cut_at, "after").otherwise("before").alias("series")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def coverage_share(known: DataFrame, ran: DataFrame, key: str, seconds: str) -> DataFrame:
    """How much of the known time was not run: one row."""
    j = known.join(ran.select(key).distinct().withColumn("_ran", F.lit(True)), key, "left")
    lost = F.sum(F.when(F.col("_ran").isNull(), F.col(seconds)).otherwise(0.0))
    return j.agg(F.count("*").alias("known"), F.count("_ran").alias("ran"), F.round(100 * lost / F.sum(seconds), 4).alias("uncovered_percent"))


def marker_lines(lines: DataFrame, markers: dict[str, str], content: str) -> DataFrame:
    """(line, marker) rows of lines that hold a marker; all markers in one pass."""
    hits = F.array_compact(F.array(*[F.when(F.col(content).contains(m), F.lit(k)) for k, m in markers.items()]))
    return lines.select("*", F.explode(hits).alias("marker"))

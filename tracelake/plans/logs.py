"""Queries of the log and CI family; log lines are composed from events, so they grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import logs as L
from tracelake.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


#: The composed lines in SQL: job, worker, line number and content.
_LINES = """WITH lines AS (SELECT user_id AS job_id, event_id AS line_no, ts, event_type, value, CASE event_type
WHEN 'error' THEN 'E ' || event_id || ' [gw' || event_id % 4 || '] FAILED tests/t' || user_id || '.py::test_' || event_id % 7 || ' - took 0x' || event_id || ' ms ''' || event_id || ''''
WHEN 'click' THEN 'I ' || event_id || ' [gw' || event_id % 4 || '] PASSED tests/t' || user_id || '.py::test_' || event_id % 7
WHEN 'view' THEN 'phases: setup=' || event_id % 9 || '.5, call=' || event_id % 5 || ', teardown=1' WHEN 'signup' THEN 'src/a' || user_id || '.c:' || event_id || ':7: error: bad ' || event_id % 3
ELSE 'make: *** [Makefile:12: build' || event_id % 6 || '] Error 2' END AS content FROM events) """


def _lines(spark: SparkSession, d: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    test = F.concat(F.lit("tests/t"), u, F.lit(".py::test_"), i % 7)
    head = F.concat(i, F.lit(" [gw"), i % 4, F.lit("] "))
    content = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("E "), head, F.lit("FAILED "), test, F.lit(" - took 0x"), i, F.lit(" ms '"), i, F.lit("'")))
        .when(F.col("event_type") == "click", F.concat(F.lit("I "), head, F.lit("PASSED "), test))
        .when(F.col("event_type") == "view", F.concat(F.lit("phases: setup="), i % 9, F.lit(".5, call="), i % 5, F.lit(", teardown=1")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("src/a"), u, F.lit(".c:"), i, F.lit(":7: error: bad "), i % 3))
        .otherwise(F.concat(F.lit("make: *** [Makefile:12: build"), i % 6, F.lit("] Error 2")))
    )
    return table(spark, d, "events").select(u.alias("job_id"), i.alias("line_no"), "ts", "event_type", "value", content.alias("content"))


_RESULT = r"^[EI] (?P<id>\d+) \[(?P<gw>gw\d)\] (?P<outcome>[A-Z]+) (?P<file>\S+)::(?P<test>\w+)"


def _results(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_log(_lines(spark, d), _RESULT, marker="::test_")


_RESULTS = _LINES + r""", results AS (SELECT *, regexp_extract(content, '\[(gw\d)\]', 1) AS gw, regexp_extract(content, '\] ([A-Z]+) ', 1) AS outcome, regexp_extract(content, ' (\S+)::', 1) AS file, regexp_extract(content, '::(\w+)', 1) AS test FROM lines WHERE contains(content, '::test_')) """


@query(_RESULTS + "SELECT job_id, line_no, gw, outcome, file, test FROM results")
def e1_parse_log(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_log(_lines(spark, d), _RESULT).select("job_id", "line_no", "gw", "outcome", "file", "test")


@query(_RESULTS + "SELECT job_id, line_no, gw, outcome, file, test FROM results")
def e2_marker_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("job_id", "line_no", "gw", "outcome", "file", "test")


_GAPS = _RESULTS + ", gaps AS (SELECT *, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY job_id, gw ORDER BY ts) AS gap_ms FROM results) "


@query(_GAPS + "SELECT line_no, gw, gap_ms FROM gaps")
def e3_worker_gaps(spark: SparkSession, d: str) -> DataFrame:
    return L.gaps(_results(spark, d), ["job_id", "gw"], "ts").select("line_no", "gw", "gap_ms")


@query(_GAPS + "SELECT file, count(*) AS n, CAST(sum(gap_ms) AS BIGINT) AS total_ms FROM gaps GROUP BY file")
def e4_file_durations(spark: SparkSession, d: str) -> DataFrame:
    return L.gaps(_results(spark, d), ["job_id", "gw"], "ts").groupBy("file").agg(F.count("*").alias("n"), F.sum("gap_ms").alias("total_ms"))


@query(_LINES + r"""SELECT line_no, CAST(regexp_extract(content, 'setup=([\d.]+)', 1) AS DOUBLE) AS setup, CAST(regexp_extract(content, 'call=([\d.]+)', 1) AS DOUBLE) AS call, CAST(regexp_extract(content, 'setup=([\d.]+)', 1) AS DOUBLE) + CAST(regexp_extract(content, 'call=([\d.]+)', 1) AS DOUBLE) + 1 AS wall FROM lines WHERE starts_with(content, 'phases: ')""")
def e5_phase_map(spark: SparkSession, d: str) -> DataFrame:
    t = _lines(spark, d).where(F.col("content").startswith("phases: ")).withColumn("m", L.phase_map(F.substr("content", F.lit(9))))
    return t.select("line_no", F.col("m")["setup"].alias("setup"), F.col("m")["call"].alias("call"), F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, x: s + x).alias("wall"))


@query("SELECT event_id, row_number() OVER w AS number, lead(ts) OVER w AS ends FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def e6_step_spans(spark: SparkSession, d: str) -> DataFrame:
    return L.spans(table(spark, d, "events"), ["user_id"], "ts").select("event_id", "number", "ends")


_ERRORS = _LINES + r""", errors AS (SELECT *, md5(regexp_replace(regexp_replace(regexp_replace(content, '0x[0-9a-fA-F]+', '<hex>', 'g'), '[0-9]+(\.[0-9]+)?', '<n>', 'g'), '''[^'']*''', '<s>', 'g')) AS fp FROM lines WHERE contains(content, 'rror') OR contains(content, 'FAILED')) """


@query(_ERRORS + "SELECT line_no, fp FROM errors")
def e7_error_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    t = _lines(spark, d).where(F.col("content").contains("rror") | F.col("content").contains("FAILED"))
    return t.select("line_no", L.fingerprint(F.col("content")).alias("fp"))


@query(_ERRORS + "SELECT fp, count(DISTINCT job_id) AS n_jobs, count(*) AS n, string_agg(DISTINCT job_id, ',' ORDER BY job_id) AS jobs FROM errors GROUP BY fp")
def e8_failure_clusters(spark: SparkSession, d: str) -> DataFrame:
    t = _lines(spark, d).where(F.col("content").contains("rror") | F.col("content").contains("FAILED"))
    return L.clusters(t.withColumn("fp", L.fingerprint(F.col("content"))), "fp", "job_id")


@query(_LINES + r"SELECT finding, count(DISTINCT job_id) AS n_jobs, count(*) AS n, string_agg(DISTINCT job_id, ',' ORDER BY job_id) AS jobs FROM (SELECT *, regexp_extract(content, 'build\d', 0) AS finding FROM lines WHERE contains(content, '*** [')) GROUP BY finding HAVING count(DISTINCT job_id) > 1")
def e9_recurring(spark: SparkSession, d: str) -> DataFrame:
    t = _lines(spark, d).where(F.col("content").contains("*** [")).withColumn("finding", F.regexp_extract("content", r"build\d", 0))
    return L.clusters(t, "finding", "job_id", at_least=2)


@query(_LINES + """SELECT line_no, n_context, severe FROM (SELECT line_no, content, count(*) OVER w AS n_context, bool_or(contains(content, 'FAILED')) OVER w AS severe FROM lines WINDOW w AS (PARTITION BY job_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE contains(content, ': error:')""")
def e10_lint_context(spark: SparkSession, d: str) -> DataFrame:
    t = L.with_context(_lines(spark, d), ["job_id"], "line_no", "content", F.col("content").contains(": error:"), 2)
    return t.select("line_no", F.size("context").cast("long").alias("n_context"), F.exists("context", lambda x: F.contains(x["content"], F.lit("FAILED"))).alias("severe"))


@query(_LINES + r"""SELECT line_no, 'pytest' AS tool, regexp_extract(content, 'FAILED (\S+?)::', 1) AS "where", regexp_extract(content, '::(\S+)', 1) AS what FROM lines WHERE contains(content, 'FAILED ') UNION ALL
SELECT line_no, 'make', 'Makefile', regexp_extract(content, ': (build\d)', 1) FROM lines WHERE contains(content, '*** [') UNION ALL SELECT line_no, 'gcc', regexp_extract(content, '^([^:]+):', 1), regexp_extract(content, 'error: (.*)$', 1) FROM lines WHERE contains(content, ': error:')""")
def e11_failures(spark: SparkSession, d: str) -> DataFrame:
    return L.failures(_lines(spark, d)).select("line_no", "tool", "where", "what")


@query("SELECT event_id::VARCHAR AS name, 'u' || user_id AS classname, round(value, 2) AS seconds, event_type = 'error' AS failed FROM events")
def e12_junit_events(spark: SparkSession, d: str) -> DataFrame:
    fail = F.when(F.col("event_type") == "error", F.lit("<failure message=\"bad\">x</failure>")).otherwise("")
    xml = table(spark, d, "events").select(F.concat(F.lit("<testcase name=\""), "event_id", F.lit("\" classname=\"u"), "user_id", F.lit("\" time=\""), F.round("value", 2), F.lit("\">"), fail, F.lit("</testcase>")).alias("x"))
    t = xml.select(F.from_xml("x", "_name string, _classname string, _time double, failure struct<_message: string>").alias("t"))
    return t.select(F.col("t._name").alias("name"), F.col("t._classname").alias("classname"), F.col("t._time").alias("seconds"), F.col("t.failure").isNotNull().alias("failed"))


@query("SELECT p_partkey, coalesce(runs, 0) AS runs, coalesce(failures, 0) AS failures, seconds FROM part LEFT JOIN (SELECT l_partkey, count(*) AS runs, count_if(l_returnflag = 'R') AS failures, round(sum(l_quantity), 2) AS seconds FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey")
def e13_coverage_by_file(spark: SparkSession, d: str) -> DataFrame:
    ran = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_returnflag") == "R").alias("failed"), "l_quantity")
    return L.coverage_by_file(table(spark, d, "part").select("p_partkey"), ran, "p_partkey", "l_quantity")


@query(_GAPS + "SELECT CAST(floor((gap_ms + 500) / 1000) AS BIGINT) AS seconds, count(*) AS n FROM gaps WHERE abs(gap_ms - floor((gap_ms + 500) / 1000) * 1000) <= 150 AND floor((gap_ms + 500) / 1000) > 0 GROUP BY 1")
def e14_plateaus(spark: SparkSession, d: str) -> DataFrame:
    return L.plateaus(L.gaps(_results(spark, d), ["job_id", "gw"], "ts"), "gap_ms")


@query(_RESULTS + "SELECT file || '::' || test AS node, count(*) AS runs, string_agg(DISTINCT outcome, ',' ORDER BY outcome) AS outcomes FROM results GROUP BY 1 HAVING count(DISTINCT outcome) > 1")
def e15_flaky(spark: SparkSession, d: str) -> DataFrame:
    return L.flaky(_results(spark, d).withColumn("node", F.concat_ws("::", "file", "test")), "node", "outcome")


@query(_RESULTS + "SELECT job_id, outcome, count(*) AS n, count(DISTINCT test) AS tests FROM results GROUP BY ALL")
def e16_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).groupBy("job_id", "outcome").agg(F.count("*").alias("n"), F.countDistinct("test").alias("tests"))


@query("""SELECT r.run_id, l_linenumber AS number, l_partkey AS id, CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_linestatus IS NOT NULL THEN 'running' END AS status, CASE WHEN l_linenumber IS NOT NULL THEN 'x' END AS unknown
FROM (SELECT DISTINCT l_orderkey AS run_id FROM lineitem) r LEFT JOIN lineitem ON l_orderkey = run_id AND l_linenumber > 1""")
def e17_jobs_from_json(spark: SparkSession, d: str) -> DataFrame:
    """Order lines but the first as jobs of a run: runs of one line have an empty list; unknown is a field that the schema does not name."""
    step = F.struct(F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("id"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("running").alias("status"), F.lit("x").alias("unknown"))
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.to_json(F.struct(F.filter(F.collect_list(step), lambda x: x["number"] > 1).alias("jobs"))).alias("body"))
    jobs = L.exploded_api(pages, "jobs array<struct<number: int, id: bigint, status: string>>", "body", "jobs")
    return jobs.withColumn("unknown", F.get_json_object("raw", "$.unknown")).drop("raw")


@query("""SELECT o_custkey AS runs_id, 'new' AS runs_state, o_orderkey AS jobs_id, o_orderstatus AS jobs_conclusion, l_linenumber AS steps_number, l_returnflag AS steps_name FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 1""")
def e17_runs_jobs_steps(spark: SparkSession, d: str) -> DataFrame:
    """Customers as runs, their orders as jobs, order lines but the first as steps, in one body a run, fetched twice: the first copy has another state."""
    lines = table(spark, d, "lineitem").where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("name"))).alias("steps"))
    jobs = table(spark, d, "orders").join(lines, "o_orderkey", "left").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("conclusion"), F.coalesce("steps", F.array().cast(lines.schema["steps"].dataType)).alias("steps"))).alias("jobs"))
    copy = lambda state, day: jobs.select(F.lit(f"2024-01-0{day}").alias("fetched"), F.to_json(F.struct(F.array(F.struct(F.col("o_custkey").alias("id"), F.lit(state).alias("state"), "jobs")).alias("runs"))).alias("body"))
    return L.api_levels(copy("new", 2).unionByName(copy("old", 1)), "body", [("runs", "id bigint, state string"), ("jobs", "id bigint, conclusion string"), ("steps", "number int, name string")], "id", "fetched")


_JOBS = """WITH jobs AS (SELECT o_custkey AS run, o_orderkey AS id, o_orderdate AS started, l_shipdate AS ended, CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'running' END AS status, CASE l_returnflag WHEN 'A' THEN 'skipped' WHEN 'N' THEN '' ELSE 'ok' END AS conclusion, l_partkey AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
timed AS (SELECT *, CAST(epoch(ended) - epoch(started) AS BIGINT) AS seconds FROM jobs WHERE status = 'completed' AND conclusion NOT IN ('skipped', '') AND ended >= started) """


def _timed(spark: SparkSession, d: str) -> DataFrame:
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    j = o.join(l, o.o_orderkey == l.l_orderkey).select(
        F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started"), F.col("l_shipdate").alias("ended"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("running").alias("status"),
        F.when(F.col("l_returnflag") == "A", "skipped").when(F.col("l_returnflag") == "N", "").otherwise("ok").alias("conclusion"), F.col("l_partkey").alias("name"),
    )
    return L.timed(j, "started", "ended", "status", "conclusion")


@query(_JOBS + "SELECT id, name, seconds FROM timed")
def e18_timed_jobs(spark: SparkSession, d: str) -> DataFrame:
    return _timed(spark, d).select("id", "name", "seconds")


@query(_JOBS + "SELECT name, count(*) AS n, list_sort(list(seconds))[((count(*) + 1) // 2)::INT] AS lower_median, max(seconds) AS worst FROM timed GROUP BY name")
def e19_long_pole(spark: SparkSession, d: str) -> DataFrame:
    return L.long_pole(_timed(spark, d), "name", "seconds")


@query(_JOBS + "SELECT id, name, run, (epoch_us(started) // 1000) - min((epoch_us(started) // 1000)) OVER (PARTITION BY run) AS offset_ms FROM timed")
def e20_gantt(spark: SparkSession, d: str) -> DataFrame:
    return L.gantt(_timed(spark, d), "run", "started").select("id", "name", "run", "offset_ms")


@query("""SELECT l_orderkey AS run_id, coalesce(string_agg(p_name, ',' ORDER BY p_name) FILTER (WHERE starts_with(p_name, 'red')), '') AS red, coalesce(string_agg(p_name, ',' ORDER BY p_name) FILTER (WHERE starts_with(p_name, 'small')), '') AS small FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def e21_gate_split(spark: SparkSession, d: str) -> DataFrame:
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    files = l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("run_id"), "p_name")
    s = L.gate_split(files, "run_id", "p_name", {"red": "red", "small": "small"})
    return s.select("run_id", F.array_join("red", ",").alias("red"), F.array_join("small", ",").alias("small"))


@query(_GAPS + ", s AS (SELECT job_id, gw, max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000)) AS wall_ms, CAST(sum(gap_ms) AS BIGINT) AS work_ms, max(gap_ms) AS slowest_ms FROM gaps GROUP BY ALL) SELECT *, round(max(wall_ms) OVER (PARTITION BY job_id) / nullif(min(wall_ms) OVER (PARTITION BY job_id), 0), 4) AS ratio FROM s")
def e22_shard_balance(spark: SparkSession, d: str) -> DataFrame:
    return L.shard_balance(L.gaps(_results(spark, d), ["job_id", "gw"], "ts"), ["job_id", "gw"], "ts", "gap_ms")


@query("""WITH m AS (SELECT o_custkey, median(o_totalprice) AS mid FROM orders GROUP BY 1) SELECT o_custkey, arg_min(o_orderkey, (abs(o_totalprice - mid), o_orderkey)) AS o_orderkey FROM orders JOIN m USING (o_custkey) GROUP BY 1""")
def e23_typical_run(spark: SparkSession, d: str) -> DataFrame:
    return L.typical(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT event_type, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 'after' ELSE 'before' END AS series, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def e24_series_split(spark: SparkSession, d: str) -> DataFrame:
    return L.series_split(table(spark, d, "events"), ["event_type"], "ts", F.lit("2024-01-15").cast("timestamp"), "value").withColumn("mean", F.round("mean", 4))


@query("SELECT count(*) AS known, count(r) AS ran, round(100 * sum(CASE WHEN r IS NULL THEN p_retailprice ELSE 0 END) / sum(p_retailprice), 4) AS uncovered_percent FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS r FROM lineitem WHERE l_quantity > 47) ON r = p_partkey")
def e25_coverage_share(spark: SparkSession, d: str) -> DataFrame:
    ran = table(spark, d, "lineitem").where("l_quantity > 47").select(F.col("l_partkey").alias("p_partkey"))
    return L.coverage_share(table(spark, d, "part"), ran, "p_partkey", "p_retailprice")


@query(_LINES + "SELECT line_no, m.k AS marker FROM lines JOIN (VALUES ('failed', 'FAILED'), ('error', 'rror'), ('worker1', '[gw1]')) m(k, v) ON contains(content, m.v)")
def e26_marker_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.marker_lines(_lines(spark, d), {"failed": "FAILED", "error": "rror", "worker1": "[gw1]"}, "content").select("line_no", "marker")

"""Edges and failure paths of the operators: nulls, ties, empty tables, refused publications, exact budgets."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracelake.functions.graph import connected_components
from tracelake.operators import activity, inventory, logs, relational, rules, similarity, spatial, text
from tracelake.sources import files, publish


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def at(s):
    return datetime.fromisoformat(f"2024-01-01 {s}")


@pytest.mark.parametrize("bucket", [None, 600])
def test_asof_ties_nulls_and_strict(spark, bucket):
    left = spark.createDataFrame([(1, "a", at("10:00:00")), (2, "a", at("09:00:00")), (3, None, at("10:00:00")), (4, "b", None), (5, "a", at("12:30:00"))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", at("10:00:00"), 7), ("a", at("09:30:00"), 6), (None, at("09:00:00"), 1)], "k string, rt timestamp, v int")
    loose = relational.asof_join(left, right, "k", "t", "rt", ["v"], bucket_seconds=bucket).select("id", "v")
    assert rows(loose, "id") == [(1, 7), (2, None), (3, None), (4, None), (5, 7)]
    strict = relational.asof_join(left, right, "k", "t", "rt", ["v"], strict=True, bucket_seconds=bucket).select("id", "v")
    assert rows(strict, "id") == [(1, 6), (2, None), (3, None), (4, None), (5, 7)]


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 20])
def test_prefix_budget_at_its_bounds(spark, n):
    df = spark.createDataFrame([("g", i, "é" * 2) for i in range(n)], "g string, i int, t string")
    got = relational.prefix_budget(df, ["g"], ["i"], "t", 5, 1000)
    assert [r["i"] for r in got.orderBy("i").collect()] == list(range(min(n, 5)))
    assert all(r["truncated"] == (n > 5) and r["reason"] == ("rows" if n > 5 else None) for r in got.collect())
    tight = relational.prefix_budget(df, ["g"], ["i"], "t", 100, 12).collect()
    assert len(tight) == min(n, 3) and all(r["reason"] == ("bytes" if n > 3 else None) for r in tight)


def test_oversized_first_row_is_told(spark):
    df = spark.createDataFrame([("g", 0, "x" * 50), ("h", 1, "y")], "g string, i int, t string")
    got = relational.prefix_budget(df, ["g"], ["i"], "t", 5, 10).orderBy("g").collect()
    assert [tuple(r) for r in got] == [("g", None, None, 1, 0, True, "oversized_row"), ("h", 1, "y", 1, 1, False, None)]
    assert [r["reason"] for r in relational.prefix_budget(df, ["g"], ["i"], "t", 0, 10).collect()] == ["rows", "rows"]


def test_islands_and_repeats(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, None), ("a", 3, True), ("b", 1, False)], "k string, i int, s boolean")
    assert rows(relational.islands(df, ["k"], ["i"], F.col("s")).select("k", "i", "island"), "k", "i") == [("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("b", 1, 0)]
    ids = spark.createDataFrame([(None, 1), (None, 2), ("x", 3), ("x", 4)], "id string, n int")
    assert [r["is_repeat"] for r in activity.mark_repeats(ids, "id", ["n"]).orderBy("n").collect()] == [False, False, False, True]


def test_indel_ratio():
    assert activity._ratio("", "") == 100 and activity._ratio("abc", "abc") == 100 and activity._ratio("abc", "xyz") == 0
    assert activity._ratio("this is a test", "this is a test!") == pytest.approx(200 * 14 / 29)
    assert activity._ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)


def test_turns_without_reply(spark):
    p = spark.createDataFrame([("s", at("10:00:00"), 1), ("s", at("11:00:00"), 2)], "k string, ts timestamp, p int")
    r = spark.createDataFrame([("s", at("11:00:00"), "x"), ("s", at("11:05:00"), "y"), ("s", at("09:00:00"), "z")], "k string, ts timestamp, r string")
    assert rows(activity.turns(p, r, "k", "ts", ["r"]).select("p", "r"), "p") == [(1, None), (2, "y")]


def test_log_patterns_and_durations(spark):
    lines = spark.createDataFrame([("FAILED a/b.py::t1 x",), ("make[1]: *** [Makefile:3: all] Error 2",), ("m.c:1:2: error: no (x)",), ("would reformat z.py",), ("fine",), (None,)], "content string")
    assert {(r["tool"], r["what"]) for r in logs.failures(lines).collect()} == {("pytest", "t1"), ("make", "all"), ("gcc", "no (x)"), ("format", "z.py")}
    t = spark.createDataFrame([("1-02:03:04",), ("02:03:04",), ("03:04",), ("x",), (None,)], "e string")
    assert [r[0] for r in t.select(inventory.parse_elapsed(F.col("e"))).collect()] == [93784, 7384, 184, None, None]


def test_rules_alias_and_verdict_order(spark):
    catalog = rules.rule_catalog([rules.Rule("a", "x > 1", "ask"), rules.Rule("b", "", "deny", base="a")])
    facts = spark.createDataFrame([(1, 5), (2, 0), (3, None)], "id int, x int")
    assert rows(rules.verdicts(rules.evaluate_rules(facts, catalog, ["id"]), ["id"]), "id") == [(1, "deny", "a,b")]
    assert rows(rules.verdict_columns(facts, catalog, ["id"]), "id") == [(1, "deny", "a,b")]
    with pytest.raises(KeyError):
        rules.rule_catalog([rules.Rule("b", "", base="none")])


def test_spatial_edges(spark):
    a = spark.createDataFrame([(1, 179.99, 0.0), (2, 10.0, 80.0)], "id int, lon double, lat double")
    b = spark.createDataFrame([(7, -179.99, 0.0), (8, 10.5, 80.0), (9, 100.0, 0.0)], "o int, lon double, lat double")
    assert [(r["id"], r["o"]) for r in spatial.knn(a, b, "id", "o", "lon", "lat", 20_000, 3).orderBy("id").collect()] == [(1, 7), (2, 8)]
    one = spark.range(1).select(spatial.ellipsoid_distance(F.lit(0.0), F.lit(0.0), F.lit(0.01), F.lit(0.0)).alias("m")).first()["m"]
    assert one == pytest.approx(1113.19, abs=0.01)


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_components(spark, small):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5), (None, 3)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"), small=small), "node"))
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for x, y in edges:
        if x is not None and x != y:
            root[max(find(x), find(y))] = min(find(x), find(y))
    assert got == {x: find(x) for x in root if find(x) != x}
    assert connected_components(spark.createDataFrame([], "a long, b long"), small=small).count() == 0
    named = connected_components(spark.createDataFrame([("x", "y"), ("z", "y")], "a string, b string"))
    assert rows(named, "node") == [("y", "x"), ("z", "x")]


def test_near_dupes_equals_all_pairs(spark):
    import random

    rng = random.Random(1)
    codes = [rng.getrandbits(62) for _ in range(40)]
    codes += [c ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for c in codes]
    got = {(r["a"], r["b"]) for r in similarity.near_dupes(spark.createDataFrame(list(enumerate(codes)), "id int, c long"), "id", "c", 3).collect()}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if (codes[i] ^ codes[j]).bit_count() <= 3}  # copies too


def test_markdown_fences(spark):
    md = "intro\n# A\n```py\n# no\n```\n## B\nx\n### C\n# D\ny"
    s = text.md_sections(spark.createDataFrame([(1, md)], "id int, t string"), "id", "t").orderBy("section").collect()
    assert [(r["level"], r["title"], r["breadcrumb"]) for r in s] == [(0, None, ""), (1, "A", "A"), (2, "B", "A > B"), (3, "C", "A > B > C"), (1, "D", "D")]


def test_fan_out_of_nothing(spark):
    assert files.fan_out(spark.createDataFrame([], "id int"), "id", lambda r: "x", 2).count() == 0


def test_publication_refusals(spark, tmp_path):
    t = publish.Table(str(tmp_path), "n", "t", schema="ds string, id int, amount int").check_not_null("id")
    t = t.check("amount is positive", lambda s: s.where("amount < 0"))
    good = spark.createDataFrame([(1, 10), (2, 20)], "id int, amount int")
    assert publish.publish(good, t, {"ds": "2024-01-01"})["rows"] == 2
    for bad, error in ((spark.createDataFrame([(None, 1)], "id int, amount int"), publish.CheckFailed), (spark.createDataFrame([(3, -1)], "id int, amount int"), publish.CheckFailed), (spark.createDataFrame([(3,)], "id int"), ValueError)):
        with pytest.raises(error):
            publish.publish(bad, t, {"ds": "2024-01-02"})
    with pytest.raises(Exception, match="CAST"):
        publish.publish(spark.createDataFrame([("x", 1)], "id string, amount int"), t, {"ds": "2024-01-02"})
    assert publish.versions(spark, t).count() == 1 and publish.read_version(spark, t).count() == 2
    publish.publish(good.where("false"), t, {"ds": "2024-01-01"})
    assert publish.read_version(spark, t).count() == 0 and publish.read_version(spark, t, 1).count() == 2
    assert not publish.has_partition(spark, t, {"ds": "2024-01-01"})
    with pytest.raises(LookupError):
        publish.latest_partition(spark, t)
    with pytest.raises(ValueError):
        publish.publish(good, t, {"ds": "x"}, "merge")
    with pytest.raises(ValueError):
        t.check("amount is positive", lambda s: s)
    other = publish.Table(str(tmp_path / "b"), "n", "t")
    assert not publish.has_table(spark, other)
    with pytest.raises(LookupError):
        publish.read_version(spark, other)


def test_objects_are_written_once_and_audited(spark, tmp_path):
    df = spark.range(10)
    files.publish_objects(df.coalesce(1), str(tmp_path), "p", "r")
    with pytest.raises(Exception, match="EXISTS|exists"):
        files.publish_objects(df, str(tmp_path), "p", "r")
    assert [r["verdict"] for r in files.audit_objects(spark, str(tmp_path), "p", "r").collect()] == ["ok"]
    df.write.mode("append").parquet(f"{tmp_path}/producer=p/run=r/data")
    assert {r["verdict"] for r in files.audit_objects(spark, str(tmp_path), "p", "r").collect()} == {"ok", "extra"}


def test_files_to_refresh(spark):
    from tracelake.streaming import jobs

    listing = spark.createDataFrame([("old", at("08:00:00")), ("late", at("09:58:00")), ("new", at("11:00:00")), ("unseen", at("01:00:00"))], "file string, modified timestamp")
    seen = spark.createDataFrame([("old",), ("late",), ("late",), ("new",)], "file string")
    todo = jobs.files_to_refresh(listing, seen, "file", "modified", F.lit(at("10:00:00")), F.expr("interval 5 minutes"))
    assert sorted(r["file"] for r in todo.collect()) == ["late", "new", "unseen"]


def test_snapshots_swap_whole(spark, tmp_path):
    from pyspark.sql.types import LongType

    broken = F.udf(lambda i: 1 // (i - 3), LongType())
    log = f"{tmp_path}/log"
    pull = lambda n, fail, when: files.snapshot_tables({"t": lambda: spark.range(n).select((broken("id") if fail else F.col("id")).alias("id")), "u": lambda: spark.range(1)}, str(tmp_path), log, spark, F.lit(at(when)))
    pull(4, False, "10:00:00")
    assert {r["table_name"]: r["status"] for r in pull(5, True, "11:00:00").collect()} == {"t": "error", "u": "ok"}
    assert files.read_snapshot(spark, log, "t").count() == 4  # a source that fails while it runs leaves its last copy
    pull(2, False, "12:00:00")
    assert files.read_snapshot(spark, log, "t").count() == 2
    with pytest.raises(LookupError):
        files.read_snapshot(spark, log, "none")


def test_api_pages_keep_empty_pages_and_unknown_fields(spark):
    pages = spark.createDataFrame([(1, '{"jobs": [{"id": 5, "extra": {"x": 1}}]}'), (2, '{"jobs": []}'), (3, "{}")], "run int, body string")
    got = logs.exploded_api(pages, "jobs array<struct<id: bigint>>", "body", "jobs").orderBy("run").collect()
    assert [(r["run"], r["id"], r["raw"]) for r in got] == [(1, 5, '{"id":5,"extra":{"x":1}}'), (2, None, None), (3, None, None)]


def test_trees_of_any_depth(spark):
    deep = "[" * 8 + "1" + "]" * 8
    assert rules.json_nodes(spark.createDataFrame([(1, deep), (2, "{"), (3, None)], "i int, j string"), "i", "j").count() == 9
    nodes = spark.createDataFrame([(1, i, i - 1 if i else None, "t" if i % 2 else "s") for i in range(20)], "tree_id int, node_id long, parent_id long, tag string")
    assert rules.ancestors(nodes).count() == 20 * 19 // 2
    assert rules.chain_max(nodes, "t").first()["longest"] == 10


def test_edges_of_small_operators(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert similarity.similar(df, df.where("false"), "id", "v", 3).collect() == []
    codes = spark.createDataFrame([(1, 7), (2, 7), (3, 1 << 40)], "id int, c long")
    assert [tuple(r) for r in similarity.near_dupes(codes, "id", "c", 1).collect()] == [(1, 2, 0)]
    texts = spark.createDataFrame([(1, "a b c d e f g"), (2, "x y")], "i int, t string")
    said = spark.createDataFrame([(1, "x y"), (2, "b c d e f g"), (3, "zz"), (4, None)], "m int, s string")
    from tracelake.operators import versions

    assert rows(versions.files_containing(texts, said, "i", "t", "m", "s", block=1), "id", "message_id") == [(1, 2), (2, 1)]
    tie = spark.createDataFrame([(1, 5), (2, 5), (3, 4)], "version int, ts int")
    tree = spark.createDataFrame([(v, "p", f"b{v}") for v in (1, 2, 3)], "version int, path string, blob string")
    assert [r["version"] for r in versions.path_history(tree, tie, "p", 1).collect()] == [2]
    wide = spark.createDataFrame([(i % 2, float(i)) for i in range(7)], "k int, v double")
    assert rows(wide.groupBy("k").agg(relational.lower_median("v").alias("m")), "k") == [(0, 2.0), (1, 3.0)]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        got = files.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5000 and all(r["content"] == f"line {r['line_no'] - 1}" for r in got)

"""Fields found in JSON lines, mergeable profiles, hexagons, nested API pages, Markdown links and front matter, idle sessions."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelake.operators import logs, spatial, text
from tracelake.sources import files
from tracelake.streaming import jobs


def test_fields_are_found(spark, tmp_path):
    lines = ['{"a": 1, "b": "x"}', '{"a": "s", "b": null, "c.d": {"e": 1}}', '{"a": 2.5, "q\\"": [1]}', "{}", "[1]", "null", "{broken", "", '{"a": true}']
    df = spark.createDataFrame([(x,) for x in [*lines, None]], "content string")
    got = {r["field"]: (r["n"], r["types"], r["mixed"]) for r in files.discover_fields(df).collect()}
    assert got["a"] == (4, {"NUMBER": 2, "STRING": 1, "BOOLEAN": 1}, True)
    assert got["b"] == (2, {"STRING": 1, "NULL": 1}, False)
    assert got["c.d"] == (1, {"OBJECT": 1}, False) and got['q"'] == (1, {"ARRAY": 1}, False)
    assert got[None][0] == 5 and files.discover_fields(df.where("false")).count() == 0
    df.where("content is not null").coalesce(1).write.text(f"{tmp_path}/n")
    v = files.read_ndjson_shallow(spark, f"{tmp_path}/n")
    assert v.columns == ["file_path", "line_no", "a", "b", "c.d", 'q"'] and v.count() == 5
    assert v.where(F.variant_get(F.col("`c.d`"), "$.e", "int") == 1).count() == 1


def test_profiles_of_parts_make_the_whole(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 100), rng.choice(["x", "y", None]), None, [1]) for i in range(30_000)]
    df = spark.createDataFrame(rows, "id int, v double, s string, none double, l array<int>")
    part = lambda k: files.profile(df.where(F.col("id") % 3 == k))
    whole = {r["column"]: r for r in files.profile(df).collect()}
    both = {r["column"]: r for r in files.merge_profiles(part(0).unionByName(part(1)).unionByName(part(2))).collect()}
    assert set(whole) == {"id", "v", "s", "none"} == set(both)
    for c, w in whole.items():
        assert [both[c][k] for k in ("type", "n", "nulls", "low", "high")] == [w[k] for k in ("type", "n", "nulls", "low", "high")]
        assert abs(both[c]["distinct"] - w["distinct"]) <= 0.05 * w["distinct"] + 1
        assert w["ranks"] is None or len(w["ranks"]) < 16_000
    ordered = sorted(r[1] for r in rows)
    for told in (files.profile(df), files.merge_profiles(part(0).unionByName(part(1)).unionByName(part(2)))):
        q = {r["column"]: r["quantiles"] for r in files.quantiles(told, (0.05, 0.5, 0.95)).collect()}
        assert set(q) == {"id", "v"}
        for rank, value in zip((0.05, 0.5, 0.95), q["v"], strict=True):
            assert abs(sum(x <= value for x in ordered) / len(ordered) - rank) < 0.015
    assert files.profile(df.where("false")).count() == 4


def test_hexagons(spark):
    rng = random.Random(3)
    size = 2.5
    df = spark.createDataFrame([(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(800)] + [(900, None, 1.0)], "id int, x double, y double")
    cells = df.where("x is not null").select("*", spatial.hex_cell(F.col("x"), F.col("y"), size).alias("h"))
    near = cells.select("x", "y", "h", *[spatial.hex_centre(F.col("h.q") + q, F.col("h.r") + r, size).alias(f"c{i}") for i, (q, r) in enumerate([(0, 0), *[s for s in spatial.hex_disk(1) if s != (0, 0)]])]).collect()
    for p in near:
        far = [math.dist((p["x"], p["y"]), tuple(p[f"c{i}"])) for i in range(7)]
        assert far[0] <= min(far) + 1e-9 and far[0] <= size + 1e-9
    assert [len(spatial.hex_disk(k)) for k in range(4)] == [1, 7, 19, 37]
    assert {(-q, -r) for q, r in spatial.hex_disk(3)} == set(spatial.hex_disk(3))
    told = spatial.with_hex_rings(spatial.hex_density(df, "x", "y", size), 1).collect()
    n = {(r["q"], r["r"]): r["n"] for r in told}
    assert sum(n.values()) == 800
    for r in told:
        assert r["around"] == sum(n.get((r["q"] + q, r["r"] + s), 0) for q, s in spatial.hex_disk(1) if (q, s) != (0, 0))
        ring = [tuple(p) for p in r["ring"]]
        assert ring[0] == ring[-1] and len(ring) == 7
        assert all(abs(math.dist(a, b) - size) < 1e-9 for a, b in zip(ring, ring[1:], strict=False))
    corners = spark.range(1).select(spatial.hex_boundary(F.lit(0), F.lit(0), 1.0).alias("a"), spatial.hex_boundary(F.lit(1), F.lit(0), 1.0).alias("b")).first()
    shared = [p for p in corners["a"][:6] if any(math.dist(tuple(p), tuple(o)) < 1e-9 for o in corners["b"])]
    assert len(shared) == 2  # neighbours share an edge


def test_levels_of_api_pages(spark):
    pages = [("1", '{"runs": [{"id": 1, "jobs": [{"id": 10, "steps": [{"number": 1}, {"number": 2}]}, {"id": 11}]}, {"id": 2, "jobs": []}]}'), ("2", '{"runs": [{"id": 1, "jobs": [{"id": 10, "steps": [{"number": 3}]}]}]}'), ("3", '{"runs": []}'), ("4", "broken"), ("5", None)]
    got = logs.api_levels(spark.createDataFrame(pages, "at string, body string"), "body", [("runs", "id bigint"), ("jobs", "id bigint"), ("steps", "number int")], "id", "at")
    assert got.columns == ["runs_id", "jobs_id", "steps_number"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 10, 3), (2, None, None)]


@pytest.mark.parametrize(("md", "want"), [
    ("a [b](c) ![d](e.png) [f]( <g> ) [h](i \"t\")", [(False, "b", "c"), (True, "d", "e.png"), (False, "f", "g"), (False, "h", "i")]),
    ("`[a](b)` [c] (d) [e][f] [g]()", []), ("```\n[a](b)\n```\n[c](d)", [(False, "c", "d")]), (None, []),
])
def test_markdown_links(spark, md, want):
    got = text.md_links(spark.createDataFrame([(1, md)], "id int, t string"), "id", "t").orderBy("line_no", "pos").collect()
    assert [(r["image"], r["label"], r["url"]) for r in got] == want


@pytest.mark.parametrize(("md", "fields", "body"), [
    ("---\na: 1\nb: 'x: y'\n---\nrest\n---\n", {"a": "1", "b": "x: y"}, "rest\n---\n"), ("---\n---\nx", {}, "x"), ("---\na: 1\n", {}, "---\na: 1\n"), ("x\n---\na: 1\n---\n", {}, "x\n---\na: 1\n---\n"),
    ("---\r\na: 1\r\na: 2\r\n---\r\nx", {"a": "2"}, "x"), ("", {}, ""), (None, {}, None), ("---\n- l\n  in: no\nurl: http://h:1/\n---", {"url": "http://h:1/"}, ""),
])
def test_front_matter(spark, md, fields, body):
    r = text.md_front_matter(spark.createDataFrame([(1, md)], "id int, t string"), "id", "t").first()
    assert (r["fields"], r["body"]) == (fields, body)


def test_idle_sessions_in_any_order(spark, tmp_path):
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    rows = [(f"k{rng.randrange(4)}" if i % 40 else None, start + timedelta(minutes=rng.randrange(3000))) for i in range(400)] + [("k0", None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    for i, part in enumerate(df.randomSplit([0.3, 0.3, 0.4], 1)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        del i
    spark.createDataFrame([("end", start + timedelta(days=90))], "k string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        s = jobs.read_stream(spark, f"{tmp_path}/in", df.schema, max_files=1)
        jobs.run_available(jobs.idle_sessions(s, "k", "ts", 3600, "40 days"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = []
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key and t is not None)
        held = [times[0], times[0], 0]
        for t in times:
            if t - held[1] >= timedelta(hours=1):
                want.append((key, *held))
                held = [t, t, 0]
            held = [held[0], t, held[2] + 1]
        want.append((key, *held))
    got = spark.read.parquet(f"{tmp_path}/out").select("k", "started", "last_seen", "n").where("k is null or k <> 'end'").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_idle_state_grows_with_buckets_not_with_keys(spark, tmp_path):
    big = (1 << 60) + 1  # and no double on the way
    df = spark.range(2000).selectExpr("case when id > 0 then id + %d end as k" % big, "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) as ts")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(-1, datetime(2024, 6, 1))], "k long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        run = jobs.run_available(jobs.idle_sessions(jobs.read_stream(spark, f"{tmp_path}/in", df.schema, max_files=1), "k", "ts", 3600, "40 days"), f"{tmp_path}/out", f"{tmp_path}/ck")
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert max(o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]) <= 4 * 256
    got = spark.read.parquet(f"{tmp_path}/out").where("k is null or k >= 0").collect()
    assert sorted((r["k"] or 0, r["started"], r["last_seen"], r["n"]) for r in got) == sorted((r["k"] or 0, r["ts"], r["ts"], 1) for r in df.collect())

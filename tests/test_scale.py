"""Joins dealt in blocks, and what stands on them, against plain loops."""

import math
import random
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from oracle import difference
from pyspark.sql import functions as F

from tracelake.operators import similarity, spatial
from tracelake.operators.activity import live_sessions
from tracelake.operators.relational import join_in_blocks
from tracelake.operators.text import contents, postings
from tracelake.plans import registry
from tracelake.session import cut, parts_of


def metres(x1, y1, x2, y2):
    r = math.radians
    h = math.sin(r(y2 - y1) / 2) ** 2 + math.cos(r(y1)) * math.cos(r(y2)) * math.sin(r(x2 - x1) / 2) ** 2
    return 2 * spatial.EARTH_M * math.asin(math.sqrt(min(1, h)))


def test_join_in_blocks_equals_join(spark):
    a = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(60)], "k int, a int")
    b = spark.createDataFrame([(i % 4, i // 2) for i in range(50)], "k int, b int")
    got = join_in_blocks(a, b, ["k"], 4, 100)
    order = lambda df: sorted(map(tuple, df.select("k", "a", "b").collect()))
    assert order(got) == order(a.join(b, "k")) != []
    assert got.rdd.getNumPartitions() == 1 + a.join(b, "k").count() // 100


def test_knn_is_exact_where_places_are_dense_repeat_or_lie_about_a_pole(spark, monkeypatch):
    rng = random.Random(3)
    spots = [(rng.gauss(10, 0.4), rng.gauss(50, 0.3)) for _ in range(60)] + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(60)] + [(rng.uniform(-180, 180), rng.choice([-1, 1]) * rng.uniform(86, 90)) for _ in range(60)]
    right = [(i, *spots[rng.randrange(len(spots))]) for i in range(300)]
    left = [(i, *rng.choice(spots)) for i in range(80)] + [(100 + i, rng.uniform(-180, 180), rng.uniform(84, 90)) for i in range(20)] + [(200, None, 1.0)]
    monkeypatch.setattr(spatial, "DENSE", 2)
    a, b = spark.createDataFrame(left, "id int, lon double, lat double"), spark.createDataFrame([*right, (900, None, 50.0)], "o int, lon double, lat double")
    got = {(r["id"], r["rank"]): r["o"] for r in spatial.knn(a, b, "id", "o", "lon", "lat", 300_000, 4).collect()}
    want = {}
    for i, x, y in left[:-1]:
        near = sorted((m, o) for o, x2, y2 in right if (m := metres(x, y, x2, y2)) <= 300_000)
        want |= {(i, n): o for n, (_, o) in enumerate(near[:4], 1)}
    assert got == want and len(want) > 200


def test_equal_rings_are_related_once(spark, monkeypatch, tmp_path):
    """A hundred squares of two shapes: four relations are told, ten thousand given."""
    log = tmp_path / "told"

    def told(a, b, plain=spatial.relation):
        with open(log, "a") as f:
            f.write("x")
        return plain(a, b)

    monkeypatch.setattr(spatial, "relation", told)
    square = lambda x: [(float(p), float(q)) for p, q in ((x, 0), (x + 2, 0), (x + 2, 2), (x, 2), (x, 0))]
    rows = spark.createDataFrame([(i, square(i % 2)) for i in range(100)], "id int, ring array<struct<lon:double,lat:double>>")
    monkeypatch.setattr(spatial, "share_code", lambda s: None)
    got = spatial.relate_polygons(rows, rows, "id", "id").groupBy("relation").count().collect()
    assert sorted(map(tuple, got)) == [("equal", 5000), ("intersects", 5000)]
    assert log.read_text() == "xxxx"


def test_equal_times_and_values_of_windows_go_by_id(spark, tmp_path):
    rows = [(i, 1 + i % 2, i // 8, float(i * 7 % 5), "view") for i in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, s int, value double, event_type string").withColumn("ts", F.timestamp_seconds("s")).orderBy(F.desc("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r for r in registry.queries()["c22_windows"](spark, str(tmp_path)).collect()}
    for u in (1, 2):
        mine = [r for r in rows if r[1] == u]
        for n, (i, _, s, _, _) in enumerate(mine):
            assert got[i]["rn"] == n + 1
            assert got[i]["prev"] == (mine[n - 1][3] if n else None)
            assert got[i]["running"] == sum(r[3] for r in mine if r[2] <= s)
            assert got[i]["best"] == min(r[0] for r in mine if r[3] == 4.0)


def test_live_sessions_list_the_others(spark):
    seen = spark.createDataFrame([(3, "a", 100), (1, "a", 100), (2, "a", 100), (4, "b", 100), (5, "x", 100), (6, "x", 100), (7, None, 100), (8, "a", 0)], "session int, branch string, s int").withColumn("last", F.timestamp_seconds("s"))
    got = {r["session"]: (r["n_others"], r["others"]) for r in live_sessions(seen, F.timestamp_seconds(F.lit(160)), 1, ["x"]).collect()}
    assert got == {1: (2, [2, 3]), 2: (2, [1, 3]), 3: (2, [1, 2]), 4: (0, []), 5: (0, []), 6: (0, []), 7: (0, [])}


def test_whole_codes_are_compared_across_blocks(spark, monkeypatch):
    rng = random.Random(5)
    codes = [rng.getrandbits(63) for _ in range(60)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(20))) for c in codes] + codes[:5] + [-1, None]
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rows = list(enumerate(codes))
    got = sorted(map(tuple, similarity.near_dupes(spark.createDataFrame(rows, "id int, c long"), "id", "c", 16, 63).collect()))
    first = {}
    for i, c in rows:
        first.setdefault(c, i)
    first.pop(None)
    near = [(i, j, n) for c, i in first.items() for d, j in first.items() if i < j and (n := ((c ^ d) & (2**64 - 1)).bit_count()) <= 16]
    assert got == sorted(near + [(first[c], i, 0) for i, c in rows if c is not None and first[c] != i])
    assert len(near) > 30


def test_published_objects_are_not_dealt_by_source(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("one").alias("source"))
    rows.repartition(4).write.option("maxRecordsPerFile", 10).parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()["a24_publish_objects"](spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [("ok", True, 40)]
    newest = max(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("evidence-*"), key=lambda f: f.stat().st_mtime)
    assert len(list(newest.glob("producer=crawler/run=r1/data/*.parquet"))) > 1


def test_what_is_cut_leaves_no_shuffle_files(spark):
    made = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().shuffleManager().shuffleBlockResolver().getStoredShuffles().size()
    before = shuffles()
    once = cut(made)
    assert shuffles() == before and cut(once.join(made, "k")).count() == 10
    # other queries keep theirs
    assert made.collect() and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_postings_are_counted_without_a_shuffle(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "B", "b", "c1", "\u00e9", "dd", "-"], k=rng.randrange(40))) for _ in range(30)] + [None, "", "--", "z"]
    got = postings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 3)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    counts = {}
    for r in got.collect():
        assert 0 <= r["bucket"] < 3 and r["n_terms"] == sum(Counter(texts[r["id"]].replace("-", "").split()).values())
        for term, tf in zip(r["terms"].split(" "), r["tfs"], strict=True):
            assert (r["id"], term) not in counts
            counts[r["id"], term] = tf
    assert counts == {(i, w): n for i, t in enumerate(texts) for w, n in Counter((t or "").lower().replace("-", "").split()).items()}


def test_partitions_grow_with_rows(spark):
    assert [parts_of(spark.range(n), 100) for n in (0, 1, 100, 101, 1000)] == [1, 1, 1, 2, 10]
    chunks = spark.createDataFrame([(f, i, f"H {i // 2}", i, i + 1) for f in range(9) for i in range(4)], "file long, chunk_idx long, heading string, page_start long, page_end long")
    outline = chunks.limit(0).selectExpr("file", "chunk_idx AS ord", "heading AS title")
    got = contents(outline, chunks, 7)
    assert got.rdd.getNumPartitions() == 7 and sorted(map(tuple, got.collect())) == sorted(map(tuple, contents(outline, chunks).collect())) != []


def test_answers_of_empty_and_null_texts(spark, tmp_path):
    """An empty text's share of letters is 0 / 0: it says 1 in SQL, a null text 0."""
    texts = ["", "", None, "", "lowercase", "UPPER", "", None, "\n", "ünder", "abcdefg123", None]
    quality = [1, 1, 0, 0, 1, 0, None, 1, 1]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [*range(len(quality)), 40], "quality": [*quality, 1]}), tmp_path / "labels.parquet")
    got = {r["doc_id"]: (r["said"], r["verdict"]) for r in registry.queries()["f24_evaluate"](spark, str(tmp_path)).collect()}
    assert got[1] == (1, "agree") and got[2] == (0, "agree") and got[3] == (1, "disagree") and got[6] == (1, "missing") and got[11] == (0, "missing") and got[40] == (None, "missing")
    assert difference(registry.queries()["f24_evaluate"](spark, str(tmp_path)), str(tmp_path), registry.oracle_sql()["f24_evaluate"]) == ""

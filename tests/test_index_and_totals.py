"""A text index that is refreshed equals a fresh one; running totals of groups of any size equal plain sums."""

import random
from collections import defaultdict
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracelake.operators import relational, text
from tracelake.operators.text_index import TextIndex
from tracelake.sources.commits import CommitLog

DOCS = "doc_id long, text string"
LATE = datetime(2100, 1, 1)


def found(df):
    return sorted((r["query"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_refreshed_index_equals_a_fresh_one(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: f"w{min(int(rng.expovariate(0.2)), 30)}"
    make = lambda: " ".join(word() for _ in range(rng.randrange(0, 20)))
    queries = spark.createDataFrame([("a", "w0 w3 w29"), ("b", "w1 zz"), ("c", "zz"), ("d", "")], "query string, text string")
    index = TextIndex(spark, f"{tmp_path}/i", 4)
    assert found(index.search(queries, 5)) == []
    have: dict = {}
    for step in range(4):
        new = {i: make() for i in rng.sample(range(60), 25 if step else 50)} | {100 + step: None}
        gone = rng.sample(sorted(have), min(len(have), 12)) if step else []
        index.refresh(spark.createDataFrame(list(new.items()), DOCS), spark.createDataFrame([(i,) for i in [*gone, 999]], "doc_id long"))
        have = {i: t for i, t in have.items() if i not in gone} | new
        docs = spark.createDataFrame(list(have.items()), DOCS)
        assert found(index.search(queries, 7)) == found(text.bm25(docs, "doc_id", "text", queries, 7)) != []
        assert index.state()["n"] == len(have)
        if step == 2:
            index.compact()
            assert len(index.state()["segments"]) == 1 and index.sweep(LATE) == 3
            assert found(index.search(queries, 7)) == found(text.bm25(docs, "doc_id", "text", queries, 7))
    index.refresh(spark.createDataFrame([], DOCS), spark.createDataFrame([(i,) for i in have], "doc_id long"))
    assert index.state()["n"] == 0 == index.state()["terms"] and found(index.search(queries, 5)) == []
    assert TextIndex(spark, f"{tmp_path}/i", 99).state()["buckets"] == 4


def test_refresh_writes_what_changed_and_dies_without_harm(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, f"{tmp_path}/i", 8)
    index.refresh(spark.range(20_000).selectExpr("id AS doc_id", "concat('common word', id, ' and more') AS text"))
    sizes = lambda: {d.name: sum(f.stat().st_size for k in ("postings", "docs") for f in Path(tmp_path, "i", k, d.name).rglob("*.parquet")) for d in Path(tmp_path, "i", "postings").iterdir()}
    whole = sum(sizes().values())
    one = spark.createDataFrame([(5, "quite other")], DOCS)
    queries = spark.createDataFrame([("q", "other"), ("r", "word5")], "query string, text string")
    before = found(index.search(queries, 3))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", die)
        with pytest.raises(KeyboardInterrupt):
            index.refresh(one)
    assert found(index.search(queries, 3)) == before and [x[:2] for x in before] == [("r", 5)]
    index.refresh(one)
    assert [x[:2] for x in found(index.search(queries, 3))] == [("q", 5)]
    assert max(v for k, v in sizes().items() if k != f"segment={index.state()['segments'][0]}") < whole / 20
    assert index.sweep(LATE) == 1
    with pytest.raises(ValueError, match="no id"):
        index.refresh(spark.createDataFrame([(None, "x")], DOCS))


@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals_by_hand(spark, parts):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", "a", "b", "c", None]), i if i % 50 else None, rng.choice([None, 1, 2, 30])) for i in range(600)]
    rows = [r for r in rows if r[1] is not None] + [("d", None, 4)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = relational.running_totals(df, ["g"], ["o"], {"t": F.col("v").cast("long"), "n": F.lit(1)}, parts)
    assert got.columns == ["g", "o", "v", "t", "n"]
    want, sums = [], defaultdict(lambda: [0, 0])
    for g, o, v in sorted(rows, key=lambda r: (str(r[0]), r[1] or -1)):
        sums[g][0] += v or 0
        sums[g][1] += 1
        want.append((g, o, v, *sums[g]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert relational.running_totals(df.where("false"), ["g"], ["o"], {"t": F.col("v")}).count() == 0


def test_one_group_uses_all_tasks(spark):
    df = spark.range(80_000).select(F.lit(1).alias("g"), "id")
    got = relational.running_totals(df, ["g"], ["id"], {"t": F.col("id")}, 8).withColumn("p", F.spark_partition_id())
    assert got.where("t <> id * (id + 1) div 2").count() == 0
    packed = relational.pack_batches(spark.createDataFrame([("x", 2, 5), ("x", 1, 6), ("x", 2, 1), ("x", 3, 9), ("y", None, 4)], "g string, k int, s int"), ["g"], "k", F.col("s"), 10)
    assert sorted(map(tuple, packed.collect()), key=str) == [("x", 1, 6, 0), ("x", 2, 6, 0), ("x", 3, 9, 1), ("y", None, 4, 0)]

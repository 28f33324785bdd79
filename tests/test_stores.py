"""Stores that batches change at the cost of the batch: nothing is lost at any cut, nothing is taken in twice."""

from datetime import date, datetime
from pathlib import Path

import pytest

from tracelake.sources.commits import CommitLog
from tracelake.streaming import jobs
from tracelake.streaming.store import BucketStore

LATE = datetime(2100, 1, 1)


def make(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v int, file string")


def kv(df, *more):
    return sorted((tuple(r[c] for c in ("k", "v", *more)) for r in df.collect()), key=str)


def test_newest_wins_and_sessions_keep_equal_rows(spark, tmp_path):
    path = f"{tmp_path}/u"
    put = jobs.upsert(path, ["k"], ["v"], 8)
    put(make(spark, ("a", 1, "f"), ("b", 1, "f")), 0)
    put(make(spark, ("a", 3, "f"), ("b", 0, "f")), 1)
    put(make(spark, ("a", 3, "f"), ("b", 0, "f")), 1)  # a batch that is run again
    put(make(spark, ("c", 1, "f")), 0)  # a new stream over the same store
    put(make(spark, ("d", 1, "f")).where("false"), 2)
    assert kv(jobs.read_store(spark, path)) == [("a", 3), ("b", 1), ("c", 1)]
    path = f"{tmp_path}/s"
    keep = jobs.rewrite_sessions(path, "k", 8)
    keep(make(spark, ("a", 1, "f"), ("a", 1, "f"), ("b", 1, "f")), 0)
    keep(make(spark, ("a", 1, "f"), (None, 2, "f")), 1)
    keep(make(spark, ("a", 1, "f"), (None, 2, "f")), 1)
    assert kv(jobs.read_store(spark, path)) == sorted([("a", 1), ("a", 1), ("a", 1), ("b", 1), (None, 2)], key=str)
    with pytest.raises(LookupError):
        jobs.read_store(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError, match="other columns"):
        BucketStore(spark, path, ["k"]).merge(spark.createDataFrame([("a",)], "k string"), lambda old, new: new)


def test_blocks_are_replaced_by_file(spark, tmp_path):
    path = f"{tmp_path}/b"
    blocks = jobs.refresh_blocks(path, "file", 4)
    blocks(make(spark, *[(f"k{i}", i, "f1") for i in range(5)], ("k0", 7, "f2")), 0)
    assert kv(jobs.read_blocks(spark, path, "k", ["v"]), "is_repeat")[:2] == [("k0", 0, False), ("k0", 7, True)]
    blocks(make(spark, ("k0", 9, "f1")), 1)  # the newest batch holds fewer rows
    assert kv(jobs.read_blocks(spark, path, "k", ["v"]), "is_repeat") == [("k0", 7, False), ("k0", 9, True)]


class Killed(RuntimeError):
    pass


@pytest.mark.parametrize("cut", ["before data", "after data", "before commit", "after commit"])
def test_a_batch_that_dies_is_taken_in_once(spark, tmp_path, monkeypatch, cut):
    store = BucketStore(spark, f"{tmp_path}/s", ["k"], 4)
    add = lambda old, new: old.unionByName(new)
    store.merge(make(spark, ("a", 1, "f"), ("b", 2, "f")), add, "q", 0)
    second = make(spark, ("a", 3, "f"), ("c", 4, "f"))
    real = CommitLog.commit

    def die(*_):
        raise Killed

    def commit(self, number, entry):
        done = real(self, number, entry) if cut == "after commit" else None
        raise Killed(done)

    with monkeypatch.context() as m:
        if cut in ("before commit", "after commit"):
            m.setattr(CommitLog, "commit", commit)
        elif cut == "after data":
            m.setattr("tracelake.streaming.store.child_folders", die)
        with pytest.raises(Killed):
            store.merge(second, die if cut == "before data" else add, "q", 1)
    want = [("a", 1), ("b", 2)] + ([("a", 3), ("c", 4)] if cut == "after commit" else [])
    assert kv(store.read()) == sorted(want)  # whole, before the batch runs again
    touched = store.merge(second, add, "q", 1)
    assert bool(touched) == (cut != "after commit")
    assert kv(store.read()) == [("a", 1), ("a", 3), ("b", 2), ("c", 4)]
    strays = store.sweep(LATE)
    assert strays == (1 if cut in ("after data", "before commit") else 0)
    assert kv(store.read()) == [("a", 1), ("a", 3), ("b", 2), ("c", 4)]


def test_writers_that_meet_lose_nothing(spark, tmp_path, monkeypatch):
    store = BucketStore(spark, f"{tmp_path}/s", ["k"], 2)
    add = lambda old, new: old.unionByName(new)
    store.merge(make(spark, ("a", 1, "f")), add)
    real, busy = CommitLog.commit, []

    def commit(self, number, entry):
        if not busy:
            busy.append(1)
            BucketStore(spark, store.path, ["k"]).merge(make(spark, ("a", 2, "f")), add)
        return real(self, number, entry)

    monkeypatch.setattr(CommitLog, "commit", commit)
    store.merge(make(spark, ("a", 3, "f")), add)
    assert kv(store.read()) == [("a", 1), ("a", 2), ("a", 3)]


def test_written_bytes_follow_the_batch(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/s", ["k"], 32)
    change = lambda old, new: old.unionByName(new)
    store.merge(spark.range(200_000).selectExpr("cast(id as string) AS k", "cast(hash(id) as int) AS v", "'f' AS file"), change)
    size = lambda: {d.name: sum(f.stat().st_size for f in d.rglob("*.parquet")) for d in Path(store.path, "data").iterdir()}
    before = size()
    assert len(store.merge(make(spark, ("5", 1, "f"), ("5", 2, "f")), change)) == 1
    (new,) = set(size().items()) - set(before.items())
    assert new[1] < sum(before.values()) / 16
    assert store.read().count() == 200_002
    for i in range(20):
        store.merge(make(spark, ("5", i, "f")), change)
    assert store.sweep(LATE) > 0 and len(store.log.numbers()) == 16 and store.read().count() == 200_022


def test_streams_take_each_batch_in_once(spark, tmp_path):
    """A restart of a stream, by its checkpoint, goes on; a second stream over the same store adds its own."""
    make(spark, ("a", 1, "f"), ("a", 1, "f")).write.parquet(f"{tmp_path}/in")
    run = lambda ck: jobs.each_batch(jobs.read_stream(spark, f"{tmp_path}/in", make(spark, ("a", 1, "f")).schema), jobs.rewrite_sessions(f"{tmp_path}/s", "k"), f"{tmp_path}/{ck}").awaitTermination()
    run("one")
    make(spark, ("b", 2, "f")).write.mode("append").parquet(f"{tmp_path}/in")
    run("one")
    assert kv(jobs.read_store(spark, f"{tmp_path}/s")) == [("a", 1), ("a", 1), ("b", 2)]
    # the note that the last batch is done is lost: it runs again
    for f in (tmp_path / "one" / "commits").iterdir():
        if f.name.lstrip(".").split(".")[0] == "1":
            f.unlink()
    run("one")
    assert kv(jobs.read_store(spark, f"{tmp_path}/s")) == [("a", 1), ("a", 1), ("b", 2)]
    run("two")
    assert len(kv(jobs.read_store(spark, f"{tmp_path}/s"))) == 6


def test_landed_days_expire_and_batches_land_once(spark, tmp_path):
    out = f"{tmp_path}/signals"
    day = lambda d: None if d is None else datetime(2024, 1, d, 12)
    rows = lambda *r: spark.createDataFrame([(k, day(d), v) for k, d, v in r], "kind string, ts timestamp, v int")
    schema = rows().schema
    told = lambda: sorted(((r["kind"], r["ds"], r["v"]) for r in jobs.read_signals(spark, out, schema).collect()), key=str)
    put = jobs.land_batch(out, "kind", "ts")
    assert told() == [] and jobs.expire_days(spark, out, date(2024, 1, 3)) == []
    first = rows(("log", 1, 1), ("log", 1, 1), ("trace", 2, 2), ("log", 3, 3), (None, 3, 4), ("log", None, 5))
    put(first, 0)
    put(rows(("log", 1, 6)), 1)
    put(first, 0)  # a batch that is run again
    put(rows().where("false"), 2)
    assert told() == sorted([("log", "2024-01-01", 1), ("log", "2024-01-01", 1), ("log", "2024-01-01", 6), ("trace", "2024-01-02", 2), ("log", "2024-01-03", 3), (None, "2024-01-03", 4), ("log", None, 5)], key=str)
    assert jobs.expire_days(spark, out, date(2024, 1, 3)) == ["2024-01-01", "2024-01-02"]
    assert not list(Path(out).glob("ds=2024-01-0[12]"))
    left = [("log", "2024-01-03", 3), (None, "2024-01-03", 4), ("log", None, 5)]
    assert told() == sorted(left, key=str)
    put(rows(("log", 1, 7)), 3)  # a row that comes late lands, and goes at the next call
    assert ("log", "2024-01-01", 7) in told() and jobs.expire_days(spark, out, date(2024, 1, 3)) == ["2024-01-01"]
    assert told() == sorted(left, key=str)
    with pytest.raises(ValueError):
        put(first.withColumnRenamed("v", "ds"), 4)

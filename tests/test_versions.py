"""Published versions: commits that one writer gets, expiry by age, and a sweep that takes what no version needs."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from pathlib import Path

import pytest

from tracelake.sources import publish as P
from tracelake.sources.commits import CommitLog

LATE = datetime(2100, 1, 1)


def day(n):
    return datetime(2024, 1, n)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def files(t):
    return {str(f.parent.relative_to(f"{t.path}/data")) for f in Path(t.path, "data").rglob("*.parquet")}


def test_a_number_goes_to_one_writer(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.latest() == (0, None) and log.numbers() == []
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: log.commit(1, {"writer": i}), range(8)))
    assert sum(won) >= 1 and log.numbers() == [1]
    assert not log.commit(1, {"writer": 9}) and log.read(1)["writer"] in [i for i, w in enumerate(won) if w]
    assert not list((tmp_path / "log").glob(".*.draft"))


def test_a_draft_is_not_read(spark, tmp_path):
    t = P.Table(str(tmp_path), "n", "t")
    P.publish(spark.createDataFrame([(1,)], "id int"), t, {"ds": "a"})
    Path(t.path, "_log", ".0.draft").write_text('{"version": 9, "kind": "replace"')
    assert P.versions(spark, t).count() == 1 and CommitLog(spark, f"{t.path}/_log").numbers() == [1]


def test_writers_that_meet_both_commit(spark, tmp_path, monkeypatch):
    """Another publication takes the number between the look at the log and the commit."""
    t = P.Table(str(tmp_path), "n", "t")
    one, two = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([("y", 2)], "v string, id int")
    P.publish(one, t, {"ds": "a"})
    real, busy = CommitLog.commit, []

    def commit(self, number, entry):
        if not busy:
            busy.append(number)
            P.publish(two, t, {"ds": "b"})
        return real(self, number, entry)

    monkeypatch.setattr(CommitLog, "commit", commit)
    assert P.publish(one, t, {"ds": "a"}, "insert")["version"] == 3
    assert sorted((r["version"] for r in P.versions(spark, t).collect())) == [1, 2, 3]
    assert ids(P.read_version(spark, t)) == [1, 1, 2] and ids(P.read_version(spark, t, 2)) == [1, 2]


def test_expiry_and_sweep(spark, tmp_path):
    t = P.Table(str(tmp_path), "n", "t")
    df = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    P.publish(df(1), t, {"ds": "a"}, at=day(1))
    P.publish(df(2), t, {"ds": "b"}, at=day(2))
    P.publish(df(3), t, {"ds": "a"}, at=day(3))
    P.publish(df(4), t, {"ds": "a"}, "insert", at=day(4))
    first = files(t)
    with pytest.raises(P.CheckFailed):
        P.publish(df(9), t.check("no", lambda s: s), {"ds": "c"})
    stray = files(t) - first
    assert len(stray) == 1
    assert P.sweep(spark, t, day(1)) == {"folders": 0, "files": 0, "bytes": 0}  # too young to be taken for a stray
    assert P.expire(spark, t, day(1)) == []
    assert P.expire(spark, t, day(3)) == [1, 2]
    for gone in (1, 2, 9):
        with pytest.raises(LookupError):
            P.read_version(spark, t, gone)
    assert ids(P.read_version(spark, t, 3)) == [2, 3] and ids(P.read_version(spark, t)) == [2, 3, 4]
    assert {r["folder"] for r in P.stray_files(spark, t, LATE).collect()} >= stray
    swept = P.sweep(spark, t, LATE)
    assert swept["folders"] == 2 and swept["bytes"] > 0  # the first copy of a, and the refused rows
    assert not files(t) & stray and len(files(t)) == 3
    assert ids(P.read_version(spark, t, 3)) == [2, 3] and ids(P.read_version(spark, t)) == [2, 3, 4]
    assert P.sweep(spark, t, LATE)["folders"] == 0
    assert P.expire(spark, t, LATE) == [3] and ids(P.read_version(spark, t)) == [2, 3, 4]  # the newest never goes
    P.publish(df(5), t, {"ds": "all"}, "replace", at=day(9))
    assert P.expire(spark, t, LATE) == [4] and P.sweep(spark, t, LATE)["folders"] == 3
    assert ids(P.read_version(spark, t)) == [5]
    P.publish(df(6).where("false"), t, {"ds": "all"}, "replace", at=day(10))
    P.expire(spark, t, LATE)
    P.sweep(spark, t, LATE)
    assert ids(P.read_version(spark, t)) == []
    assert P.expire(spark, P.Table(str(tmp_path), "n", "other"), LATE) == []


def test_commit_times(spark, tmp_path):
    t = P.Table(str(tmp_path), "n", "t")
    before = datetime.now()
    P.publish(spark.createDataFrame([(1,)], "id int"), t, {"ds": "a"})
    at = P.versions(spark, t).first()["at"]
    assert abs((at - before).total_seconds()) < 600


def test_null_and_its_name_are_two_partitions(spark, tmp_path):
    t = P.Table(str(tmp_path), "n", "t", ("ds", "c"))
    one = spark.createDataFrame([(1,)], "id int")
    P.publish(one, t, {"ds": "a", "c": None})
    P.publish(one, t, {"ds": "a", "c": "None"})
    P.publish(one.where("false"), t, {"c": "None", "ds": "a"})
    assert P.has_partition(spark, t, {"ds": "a", "c": None}) and not P.has_partition(spark, t, {"ds": "a", "c": "None"})

"""Runs of words, ranked search and exact copies against brute force, and their odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import exact_dedup, lexical_search, periodic_runs
from tracelake.llm.decontaminate import words_of

DOC = "doc_id long, text string, lang string, h long, t string, `a b` int"


# runs


def plain_runs(w, times=4, least=6):
    """Every period, every stretch of equal words at that distance; of the same stretch the least period."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def texts(seed):
    rng = random.Random(seed)
    yield list("a" * 60)
    yield list("ab" * 30) + list("a" * 9) + list("ab" * 20)
    yield fibonacci(150)
    yield [*("xyz" * 8), "q", *("xyz" * 8)]
    for _ in range(40):
        yield [rng.choice("ab") for _ in range(rng.randrange(0, 90))]
    for _ in range(60):
        w = []
        for _ in range(rng.randrange(1, 6)):
            part = [rng.choice("abcd") for _ in range(rng.randrange(1, 7))]
            w += (part * rng.randrange(1, 9))[: rng.randrange(1, 50)]
        yield w


@pytest.mark.parametrize(("times", "least"), [(4, 6), (3, 3), (5, 2), (3, 12)])
def test_runs_by_hand(times, least):
    all_texts = list(texts(3))
    flat = [c for w in all_texts for c in w]
    number = {c: i + 1 for i, c in enumerate(sorted(set(flat)))}
    first = np.concatenate(([0], np.cumsum([len(w) for w in all_texts])))
    got = [tuple(r) for r in periodic_runs.runs_of(np.array([number[c] for c in flat]), first, times, least).tolist()]
    assert got == [(i, *r) for i, w in enumerate(all_texts) for r in plain_runs(w, times, least)]


def test_pairs_stay_few_in_long_runs():
    """A run gives a pair a multiple of its period, not one a pair of places."""
    words = np.array([1, 2, 3] * 20_000 + [4] * 20_000 + [-1])
    at, shared = periodic_runs.sorted_repeats(words, 5)
    assert len(at) >= 79_000
    pairs = periodic_runs.maximal_pairs(at, shared, np.append(-2, words[:-1]))
    assert len(pairs) == 2 * (20_000 // 4)
    assert periodic_runs.runs_of(words[:-1], np.array([0, 80_000])).tolist() == [[0, 0, 60_000, 3], [0, 60_000, 20_000, 1]]


def test_report_and_collapsed_text_by_hand(spark):
    rng = random.Random(8)
    rows = [(i, " \n".join(rng.choice("ab") for _ in range(rng.randrange(0, 80)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "x " * 3000), (None, "b c " * 9), (903, "x " * 3000)]
    docs = spark.createDataFrame([(i, t, None, 1, "z", 2) for i, t in rows], DOC).repartition(3)
    words = docs.select("doc_id", periodic_runs.words_of(F.col("text")).alias("words"))
    got = periodic_runs.periodic_report(words, periodic_runs.with_periodic_tails(F.col("words"), F.col("doc_id"))).collect()
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for j, x in enumerate(w) if j not in gone))]
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha))
    assert sum(r[1] for r in want) > 20
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_runs_of_odd_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert periodic_runs.periodic_report(empty, periodic_runs.words_of(F.col("text"))).count() == 0
    docs = spark.createDataFrame([(1, "a b " * 5 + "c", "en", 5, "t1", 7), (2, None, None, None, None, None)], DOC)
    got = periodic_runs.collapse_runs(docs, F.split("text", " "))
    assert got.columns == [*docs.columns, "runs", "collapsed"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["collapsed"] == "a b c" and rows[1]["a b"] == 7 and tuple(rows[1]["runs"][0]) == (0, 10, 2)
    assert rows[2]["collapsed"] == "" and rows[2]["runs"] == []
    with pytest.raises(ValueError):
        periodic_runs.collapse_runs(docs, F.split("text", " "), times=2)


# search


def plain_ranks(docs, items, k):
    terms = {i: words_of(t) for i, t in enumerate(t for _, t in docs)}
    n_docs, n_terms = sum(1 for w in terms.values() if w), sum(map(len, terms.values()))
    df = Counter(w for x in terms.values() for w in set(x))
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(words_of(text))
    out = []
    for item, words in asked.items():
        scored = []
        for i, (doc, _) in enumerate(docs):
            tf, n = Counter(terms[i]), len(terms[i])
            if n:
                m = 10 + 90 * n * n_docs // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in words if tf[w])
                if s > 0:
                    scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_ranks_by_hand(spark, block_bytes):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["Ünï", "A1"]
    docs = [(i, " ".join(rng.choices(vocab, [1 / (j + 1) for j in range(len(vocab))], k=rng.randrange(0, 25)))) for i in range(300)]
    docs += [(1000 + i, "w1 w2, w3") for i in range(40)] + [(None, "w1 w2 w3 w39"), (500, None), (501, "  !! "), (7, docs[7][1])]
    items = [(1, "w1 w2 w3"), (2, "W39 w39 a1"), (3, None), (None, "w1"), (4, "absent"), (5, "w0"), (6, "ünï Ünï w5"), (1, "w4"), (7, "")]
    frame = spark.createDataFrame([(i, t, None, 1, "z", 2) for i, t in docs], DOC).repartition(3)
    got = lexical_search.ranked_documents(frame, spark.createDataFrame(items, "item_id long, text string"), 10, block_bytes=block_bytes)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(plain_ranks(docs, items, 10))
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.ranked_documents(frame, none).count() == 0
    assert lexical_search.ranked_documents(spark.createDataFrame([], DOC), spark.createDataFrame([(1, "w1")], none.schema)).count() == 0


def test_shards_stop_early_and_lose_nothing():
    """Best positions against full scores, over many shards that hand on what they found; ties at the kth score go by id."""
    rng = np.random.default_rng(6)
    for trial in range(30):
        n_docs, n_vocab, k = 400, 12, 5
        parts, everything = [], []
        for s in range(3):
            ids = rng.permutation(np.arange(s, 3 * n_docs, 3))
            keys = np.unique(rng.integers(0, n_docs * n_vocab, 1500))
            impact = rng.integers(0, 4 if trial % 2 else 1000, len(keys))
            first = np.searchsorted(keys, np.arange(n_docs + 1) * n_vocab)
            parts.append((ids, lexical_search.Shard(ids, first, keys % n_vocab, impact, n_vocab), keys, impact))
        for terms in ([0], [1, 2, 3], list(range(n_vocab))):
            top = (np.zeros(0, np.int64),) * 2
            everything = Counter()
            for ids, shard, keys, impact in parts:
                top = shard.best(np.array(terms), k, top)
                for key, x in zip(keys.tolist(), impact.tolist(), strict=True):
                    if key % n_vocab in terms:
                        everything[int(ids[key // n_vocab])] += x
            want = sorted((-s, i) for i, s in everything.items() if s > 0)[:k]
            assert [(-s, i) for s, i in zip(*map(np.ndarray.tolist, top), strict=True)] == want


def test_reading_ends_at_the_best_positions(monkeypatch):
    n = 10_000
    impact = np.concatenate([np.full(20, 10_000), np.full(n - 20, 1)])
    shard = lexical_search.Shard(np.arange(n), np.arange(n + 1), np.zeros(n, np.int64), impact, 1)
    read = []
    whole = lexical_search._ranges
    monkeypatch.setattr(lexical_search, "_ranges", lambda a, b: read.append(int((b - a).sum())) or whole(a, b))
    scores, ids = shard.best(np.array([0]), 10, (np.zeros(0, np.int64),) * 2)
    assert ids.tolist() == list(range(10)) and sum(read) < 200


# copies


def plain_groups(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "last" else min)(known) if known else None
        left = 1
        for i in ids:
            stays = left > 0 and i == best
            left -= stays
            out.append((i, best, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


COPIES = [(i, f"text {i % 7}") for i in range(50)] + [(60, None), (61, ""), (62, "Text 1"), (63, "text 1 "), (None, "text 1"), (None, "only"), (None, "only"), (64, "é"), (65, "é"), (5, "text 5"), (5, "text 5"), (5, "other"), (70, "x" * 300_000), (71, "x" * 300_000)]


@pytest.mark.parametrize(("keep", "hashed", "large"), [
    ("first", exact_dedup.content_hash, False), ("last", exact_dedup.content_hash, True),
    ("last", lambda t: F.unhex(F.substring(F.md5(t), 1, 1)), False), ("first", lambda t: F.unhex(F.substring(F.md5(t), 1, 1)), True),
    ("last", lambda t: F.lit(b"same"), False),
])
def test_copies_by_hand(spark, monkeypatch, keep, hashed, large):
    """Also with hashes that collide, and without broadcasts."""
    if large:
        monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 0)
    docs = spark.createDataFrame([(i, t, None, 1, "z", 2) for i, t in COPIES], DOC).repartition(5)
    got = exact_dedup.exact_groups(docs, keep=keep, hashed=hashed)
    assert sorted(map(tuple, got.collect()), key=str) == plain_groups(COPIES, keep)
    kept = exact_dedup.drop_exact_copies(docs, keep=keep, hashed=hashed)
    assert kept.columns == docs.columns
    assert sorted(((r[0], r[1] or "") for r in kept.collect()), key=str) == sorted({(r[0], t or "") for r in plain_groups(COPIES, keep) if r[3] for t in [next(t for _, t in COPIES if hashlib.sha256((t or "").encode()).hexdigest() == r[4])]}, key=str)


def test_copies_of_odd_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0
    docs = spark.createDataFrame([("b", "A"), ("a", "a"), ("c", "b")], "id string, body string")
    got = exact_dedup.exact_groups(docs, "id", "body", normalise=F.lower)
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in got.collect()) == [("a", "a", True), ("b", "a", False), ("c", "c", True)]
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(docs, "id", "body", keep="any")
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

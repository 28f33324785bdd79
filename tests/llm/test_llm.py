"""Training-data operators: brute force, round trips, held-out accuracy, and odd rows of every kind."""

import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from oracle import difference
from pyspark.sql import functions as F

from tracelake.llm import chat, cotraining, decontaminate, html_extract, langid, license_scan, mixing, quality_rules, simhash, substring_dedup
from tracelake.llm.license_texts import TEMPLATES
from tracelake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, pos int, _t string"
NAMES = ["the", "cat", "sat", "on", "a", "mat", "and", "ran", "off", "with", "my", "hat", "while", "dogs", "bark", "at", "night", "under", "some", "tree"]


def odd_docs(spark):
    """Nulls in every column, empty, blank, symbol-only and very long texts, ties, repeated rows, clashing extra names."""
    rng = random.Random(5)
    long = " ".join(rng.choice(NAMES) + str(rng.randrange(50)) for _ in range(30_000))
    texts = [None, "", "   \n\t", "!!! ###", "a", long, "same text here", "same text here", "Ünïcödé ß 日本語 текст", "x퟿ y", long + " end"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 2 else f"s{i}", None if i == 4 else 7, 1, 2, 3, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None, 1, 1, 1, None), rows[6], rows[6]], DOC), len(rows) + 3


def empty_docs(spark):
    return spark.createDataFrame([], DOC)


def benchmark_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), SF, ORACLE_SQL[name]) == ""


@tables
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_rows_of_odd_tables(spark):
    docs, n = odd_docs(spark)
    bench = benchmark_of(spark, [(1, "the cat sat on a mat and ran off with my hat"), (None, "x y"), (2, None), (3, "")])
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 1, None), (None, 1, 0), (9, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    whole = {
        "lang": langid.language_report, "sim": simhash.simhash_groups, "mix": mixing.mixing_plan, "rules": quality_rules.quality_report,
        "quality": lambda d: cotraining.quality_scores(d, labels), "bench": lambda d: decontaminate.contamination_report(d, bench),
    }
    for op in whole.values():
        assert op(docs).count() == n
        assert op(empty_docs(spark)).count() == 0
    for op in (substring_dedup.repeated_passages, lambda d: license_scan.license_scan(d, TEMPLATES)):
        op(docs).count()
        assert op(empty_docs(spark)).count() == 0
    for stage in (langid.keep_identified, simhash.simhash_dedup, substring_dedup.cut_passages, lambda d: decontaminate.decontaminate(d, bench)):
        got = stage(docs)
        assert got.columns == docs.columns and got.count() <= n
        assert stage(empty_docs(spark)).count() == 0
    assert mixing.mix(docs).columns == [*docs.columns, "sample_prob"]


CLASHES = "_n _n_words _spans _items _u _lang_of _cut_id _left _own0 _own1 _own2 _own3 _own4 _own5 _text node root id h p sig bands fp".split()


@pytest.mark.parametrize("stage", ["language", "copies", "passages", "leaks", "mix"])
def test_stages_keep_columns_of_any_name(spark, stage):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(NAMES) + str(rng.randrange(90)) for _ in range(90)), "en", f"s{i % 2}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASHES])
    bench = benchmark_of(spark, [(1, " ".join(NAMES) * 2)])
    run = {"language": langid.keep_identified, "copies": simhash.simhash_dedup, "passages": substring_dedup.cut_passages, "leaks": lambda d: decontaminate.decontaminate(d, bench), "mix": lambda d: mixing.mix(d, rate=0.9)}[stage]
    got = run(docs).collect()
    assert len(got) > 10 and all(r[c] == f"{c}-{r['doc_id']}" for r in got for c in CLASHES)


def test_repeated_ids_and_null_ids_of_the_dedup(spark):
    a, b = " ".join(NAMES), " ".join(reversed(NAMES))
    rows = [(1, a), (1, a), (2, b), (2, f"{b} more"), (None, a), (None, a), (None, b), (3, None), (4, ""), (5, a)]
    got = sorted(map(tuple, simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, a), (None, b), (3, None)], key=str)


# language


@tables
def test_predictions_by_hand(spark):
    """Letter by letter in plain Python, from the definition: no cache, no batches, no packing."""
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    dim = langid.DIM
    vectors: dict[str, np.ndarray] = {}

    def vector(c):
        if c not in vectors:
            vectors[c] = np.random.default_rng(ord(c) if c != " " else 0).integers(0, 2, dim, dtype=np.int8).astype(np.int64) * 2 - 1
        return vectors[c]

    def bundle(text):
        clean = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
        out = np.zeros(dim, np.int64)
        if clean:
            grams: dict[str, int] = {}
            for g in (f" {clean} "[i : i + 3] for i in range(len(clean))):
                grams[g] = grams.get(g, 0) + 1
            for g, n in grams.items():
                out += n * np.roll(vector(g[0]), 2) * np.roll(vector(g[1]), 1) * vector(g[2])
        return out, bool(clean)

    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id}
    made = {r.doc_id: bundle(r.text) for r in docs.itertuples()}
    sums: dict[str, np.ndarray] = {}
    for r in docs.itertuples():
        if not held[r.doc_id] and r.lang is not None:
            sums[r.lang] = sums.get(r.lang, 0) + made[r.doc_id][0]
    got = {r["doc_id"]: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, (v, told) in made.items():
        cos = {k: float(v @ s / (np.linalg.norm(v) * np.linalg.norm(s))) for k, s in sums.items()} if told else {}
        best = max(sorted(cos), key=cos.get) if cos else "und"
        assert got[i]["held_out"] == held[i]
        assert abs(got[i]["score"] - max(cos.get(best, 0.0), 0.0)) < 1e-4 and (got[i]["lang_pred"] == best or sorted(cos.values())[-1] - sorted(cos.values())[-2] < 1e-4)


def test_language_accuracy_and_und(spark):
    rng = random.Random(2)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    rows = []
    for i in range(240):
        lang = sorted(alphabets)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(30)), lang))
    rows += [(1000, "123 !!", "aa"), (1001, None, "bb")]
    got = {r["doc_id"]: r for r in langid.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(i, lang) for i, _, lang in rows[:240] if got[i]["held_out"]]
    assert len(held) > 30 and sum(got[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001)] == ["und", "und"]
    none = langid.language_report(spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)


def test_bundles_add_up():
    e = langid.Encoder(64)
    g, c = langid.ngrams("the cat and the hat")
    direct = sum(n * e.bind(np.array([x]))[0] for x, n in zip(g, c, strict=True))
    assert np.allclose(direct, e.bundle(g, c)) and np.allclose(direct, next(e.bundles([(g, c)])))


def test_languages_are_told_once_and_in_little_memory(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words {i}", "en", "web") for i in range(8)], "doc_id long, text string, lang string, source string")
    assert langid.keep_identified(docs)._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert langid.keep_identified(docs).count() == 8
    e = langid.Encoder()
    assert e.bound.nbytes <= 1 << 24
    monkeypatch.setattr(langid, "_ROWS", 5)
    g, c = langid.ngrams("the cat and the hat")
    assert np.array_equal(e.bundle(g, c), next(e.bundles([(g, c)]))) and np.array_equal((c << 24) @ e.bind(g).astype(float), next(e.bundles([(g, c << 24)])))


# simhash


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components_by_hand(spark):
    rng = random.Random(9)
    base = [[rng.choice(NAMES) + str(rng.randrange(9)) for _ in range(rng.choice([0, 1, 3, 40, 200]))] for _ in range(40)]
    texts = [" ".join(w) for w in base]
    for w in base:
        if len(w) > 30:
            for _ in range(6):
                v = list(w)
                v[rng.randrange(len(v))] = "edit"
                texts.append("\t".join(v).upper())
    got = {r["doc_id"]: r for r in simhash.simhash_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    prints = [by_hand(t) for t in texts]
    assert all(got[i]["fingerprint"] == f"{p:016x}" for i, p in enumerate(prints))
    label = list(range(len(texts)))
    while True:
        new = [min(label[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(texts))]
        if new == label:
            break
        label = new
    assert [got[i]["component_id"] for i in range(len(texts))] == label


def test_masks_cover_every_pair():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(4)]
    rng = random.Random(0)
    assert len(masks) == 31
    for _ in range(5000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
        assert any(m & diff == 0 for m in masks)


def _brute_groups(points, radius=4):
    """The smallest fingerprint reachable from each, by comparing all pairs."""
    p = np.array(points, np.int64)
    label = np.arange(len(p))
    near = [np.flatnonzero(np.bitwise_count(p ^ x) <= radius) for x in p]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return {points[i]: points[label[i]] for i in range(len(points))}
        label = new


@pytest.mark.parametrize(("n", "spread", "large"), [(600, 4, 64), (600, 4, 8), (1500, 9, 16), (300, 6, 1)])
def test_large_groups_of_fingerprints_by_hand(spark, n, spread, large):
    rng = random.Random(n + spread)
    centre = rng.getrandbits(62)
    points = sorted({centre ^ sum(1 << b for b in rng.sample(range(62), rng.randrange(0, spread))) for _ in range(n)} | {rng.getrandbits(62) for _ in range(50)})
    got = {r["fp"]: r["root"] for r in simhash.fingerprint_groups(spark.createDataFrame([(p,) for p in points], "fp long"), large=large).collect()}
    assert {p: got.get(p, p) for p in points} == _brute_groups(points)


def test_exploded_rows_are_not_broadcast_by_a_guess(spark, monkeypatch):
    """Spark sizes exploded rows as if each made one; here that is within the limit, and what they are is 30 times beyond it."""
    limit, plans, plain = "200000", [], simhash.cut

    def seen(df):
        run = df.select("*")
        run.collect()
        plans.append(run._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return plain(df)

    def under(plan, node):
        """The plans of what stands under each such node."""
        lines = plan.split("\n")
        depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
        for i, x in enumerate(lines):
            if node in x:
                yield "\n".join(itertools.takewhile(lambda y, d=depth(x): depth(y) > d, lines[i + 1 :]))

    monkeypatch.setattr(simhash, "cut", seen)
    points = spark.createDataFrame([(int(p),) for p in np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 3000)], "fp long").groupBy("fp").count().select("fp")
    name, other = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        simhash.fingerprint_groups(points).collect()
        assert spark.conf.get(name) == limit and spark.conf.get(other, None) is None
    finally:
        spark.conf.set(name, before)
    assert any("Generate" in p for p in plans)
    assert not [x for p in plans for x in under(p, "BroadcastExchange") if "Generate" in x]


def test_cost_of_a_group_within_eight_bits(spark, monkeypatch):
    rng = random.Random(4)
    centre = rng.getrandbits(62)
    sizes = {}
    for n in (1000, 4000):
        points = sorted({centre ^ sum(1 << b for b in rng.sample(range(62), rng.randrange(0, 9))) for _ in range(n)})
        seen = []

        def counted(points, divide, near, levels, large=64, seen=seen, plain=simhash.bucket_groups):
            def near2(pairs, ends):
                pairs = simhash.cut(pairs)
                seen.append(pairs.count())
                return near(pairs, ends)

            return plain(points, divide, near2, levels, large)

        with monkeypatch.context() as m:
            m.setattr(simhash, "bucket_groups", counted)
            simhash.fingerprint_groups(spark.createDataFrame([(p,) for p in points], "fp long"), large=16).count()
        sizes[n] = sum(seen)
    assert sizes[4000] < 6 * sizes[1000]


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(8)
    make = lambda: [rng.choice(NAMES) + str(rng.randrange(40)) for _ in range(300)]
    clean = [make() for _ in range(30)]
    copies = []
    for w in clean[:15]:
        v = list(w)
        v[rng.randrange(300)] = "edited"
        copies.append(v)
    rows = [(i, " ".join(w)) for i, w in enumerate(clean + copies + clean[:5])]
    kept = {r["doc_id"] for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(30)) <= kept and len(kept - set(range(30))) <= 2


def test_pairs_go_by_their_exact_similarity(spark):
    rng = random.Random(3)
    new = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows, near = [], set()
    for i, other in enumerate((50, 41, 33, 25, 20, 16, 10, 5) * 12):
        w = new(204)  # 200 shingles, of which 200 - other stay: similarities of 0.60, 0.66, 0.72, 0.78, 0.82, 0.85, 0.90, 0.95
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: 204 - other] + new(other)))]
        if 200 - other >= 0.8 * (200 + other):
            near.add(2 * i + 1)
    kept = {r["doc_id"] for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {i for i, _ in rows} - kept
    text = dict(rows)
    # below 0.8 only what the op's own four bits link
    assert near <= gone and all((simhash.fingerprint(text[i]) ^ simhash.fingerprint(text[i - 1])).bit_count() <= 4 for i in gone - near)


@tables
def test_similar_documents_of_the_tables_meet(spark):
    """All pairs of sf0.01 whose five-word shingles have a Jaccard similarity of 0.8 or more, found by brute force, end in one group."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    ids, holders = sorted(sets), {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    shared: dict[tuple, int] = {}
    for own in holders.values():
        for n, b in enumerate(own):
            for a in own[:n]:
                shared[a, b] = shared.get((a, b), 0) + 1
    near = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    kept = {r["doc_id"] for r in simhash.simhash_dedup(docs).collect()}
    assert len(near) > 20 and not [p for p in near if p[0] in kept and p[1] in kept]


def test_copies_of_one_text_make_one_group_at_small_cost(spark, monkeypatch):
    rng = random.Random(14)
    new = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    base = new(150)
    texts = []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):  # similarities of some 0.6 to 0.95 to each other
            w[rng.randrange(150)] = new(1)[0]
        texts.append(" ".join(w))
    sets = [{tuple(w[j : j + 5]) for j in range(146)} for w in map(str.split, texts)]
    group = list(range(300))
    for i in range(300):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    kept = {r["doc_id"] for r in simhash.simhash_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    # op4's own bits may link more
    assert 0 in kept and kept <= set(group)


# passages


def test_passages_of_fifty_words_are_found(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    fuzzy = [w if i % 17 else "changed" for i, w in enumerate(passage)]
    docs = [[word() for _ in range(200)] for _ in range(12)]
    for i in (3, 5, 7):
        docs[i][50:50] = passage
    docs[9][20:20] = fuzzy
    docs[10][10:10] = passage[:30]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.repeated_passages(df).collect()
    assert {(r["doc_id"], r["match_id"]) for r in got} == {(5, 3), (7, 3), (9, 3)}
    assert all((r["start"], r["end"], r["match_start"], r["match_end"]) == (50, 110, 50, 110) and r["identity"] == 1 for r in got if r["doc_id"] != 9)
    nine = next(r for r in got if r["doc_id"] == 9)
    assert nine["start"] <= 24 and nine["end"] >= 76 and nine["identity"] >= 0.9
    left = {r["doc_id"]: r["text"] for r in substring_dedup.cut_passages(df).collect()}
    assert len(left) == 12 and left[3] == rows[3][1] and left[5] == " ".join(docs[5][:50] + docs[5][110:])


def test_two_passages_of_one_pair_are_both_found(spark):
    rng = random.Random(4)
    new = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    gaps = [(0, 100), (30, 60), (50, 50), (100, 100), (0, 200)]
    rows, want, hit = [], {}, {}
    for i, (before, after) in enumerate(gaps * 6):
        p, q = new(60), new(60)
        rows += [(2 * i, " ".join(new(20) + p + new(before) + q + new(20))), (2 * i + 1, " ".join(new(30) + p + new(after) + q + new(30)))]
        want[2 * i + 1] = set(range(30, 90)) | set(range(90 + after, 150 + after))
    for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["match_id"] == r["doc_id"] - 1 and r["identity"] >= 0.8
        hit.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert hit == want


def test_fuzzy_passages_are_found_by_few_seeds(spark):
    rng = random.Random(6)
    new = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows = []
    for every in (6, 8, 10):
        for _ in range(40):
            i, p = len(rows), new(60)
            fuzzy = [w if k % every != every - 1 else new(1)[0] for k, w in enumerate(p)]
            rows += [(i, " ".join(new(40) + p + new(40))), (i + 1, " ".join(new(50) + fuzzy + new(30)))]
    found = {r["doc_id"] for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(i % 2 for i in found)
    share = [len([i for i in found if 80 * n <= i < 80 * n + 80]) for n in range(3)]
    assert share[0] >= 32 and share[1] >= 36 and share[2] >= 38


def with_words_more_and_less(rng, passage, new, share):
    """The passage, some of whose words are dropped and some followed by a new one."""
    return [v for w in passage for v in ([w] if rng.random() >= share else [] if rng.random() < 0.5 else [w, *new(1)])]


def test_passages_with_words_more_and_less_are_found(spark):
    """What stands around a seed shifts with every such word; it leaves out no holder."""
    rng = random.Random(12)
    new = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows = []
    for _ in range(60):
        i, p = len(rows), new(80)
        rows += [(i, " ".join(new(100) + p + new(100))), (i + 1, " ".join(new(100) + with_words_more_and_less(rng, p, new, 0.1) + new(100)))]
    words = {}
    for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["doc_id"] % 2 and r["match_id"] == r["doc_id"] - 1
        words.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert len([w for w in words.values() if len(w) >= 50]) >= 50


def test_every_run_is_a_seed(spark):
    codes = np.random.default_rng(0).integers(0, 1 << 32, 500).astype(np.uint64)
    assert substring_dedup.seeds(codes)[0].tolist() == list(range(500 - substring_dedup.K + 1))
    parts = [substring_dedup._seeds(codes, np.array([0, 500]), part)[0].tolist() for part in range(substring_dedup.PARTS)]
    assert sorted(itertools.chain(*parts)) == list(range(496)) and all(parts)
    # a passage may have few runs that are left whole
    rng = random.Random(13)
    new = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows = []
    for _ in range(60):
        i, p = len(rows), new(80)
        rows += [(i, " ".join(new(100) + p + new(100))), (i + 1, " ".join(new(100) + with_words_more_and_less(rng, p, new, 0.15) + new(100)))]
    words = {}
    for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["doc_id"] % 2 and r["match_id"] == r["doc_id"] - 1
        words.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert len([w for w in words.values() if len(w) >= 50]) >= 57


def test_passages_whose_seeds_others_hold_first(spark):
    rng = random.Random(9)
    new = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    p = new(60)
    # no earlier document holds more than a sixth of the passage
    rows = [(i, " ".join(new(40) + p[max(0, 10 * i - 4) : 10 * i + 10] + new(40))) for i in range(6)]
    rows += [(10, " ".join(new(30) + p + new(30))), (11, " ".join(new(20) + p + new(50)))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any((r["doc_id"], r["match_id"]) == (11, 10) and r["end"] - r["start"] >= 58 for r in got)


def test_phrases_that_many_hold_hide_no_passage(spark):
    rng = random.Random(10)
    new = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    p = new(60)
    rows = [(i, " ".join(p[i : i + 5])) for i in range(56)] + [(100, " ".join(new(40) + p + new(40))), (101, " ".join(new(10) + p + new(70)))]
    # and each phrase in other texts between the two
    rows += [(200 + i, " ".join(new(20) + p[i % 56 : i % 56 + 5] + new(20))) for i in range(400)] + [(900, " ".join(new(15) + p + new(5)))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {i: {w for r in got if r["doc_id"] == i for w in range(r["start"], r["end"])} for i in (101, 900)}
    assert spans == {101: set(range(10, 70)), 900: set(range(15, 75))} and {r["doc_id"] for r in got} == {101, 900}


def test_exact_passages_against_all_pairs(spark):
    rng = random.Random(11)
    phrases = [[rng.choice(NAMES) + str(rng.randrange(9)) for _ in range(rng.choice([4, 8, 60, 75]))] for _ in range(40)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += rng.choice(phrases) if rng.random() < 0.6 else [rng.choice(NAMES) + str(rng.randrange(9)) for _ in range(rng.randrange(30))]
        rows.append((i, words))
    held: dict[tuple, int] = {}
    want = {}
    for i, w in rows:
        runs = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        want[i] = {j + t for j, r in enumerate(runs) if held.get(r, i) < i for t in range(50)}
        for r in runs:
            held.setdefault(r, i)
    found: dict[int, set] = {}
    for r in substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert sum(map(len, want.values())) > 1000
    assert all(want[i] <= found.get(i, set()) for i, _ in rows)


@pytest.mark.parametrize("held_later", [False, True])
def test_passages_whose_phrases_smaller_ids_hold(spark, held_later):
    """Holders at any places, where smaller ids hold all phrases of the passage apart, or hold those before the passage itself."""
    rng = random.Random(5)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    p = new(60)
    phrases = lambda: [w for a in range(0, 60, 5) for w in new(7) + p[a : a + 9]]
    rows = [(0, " ".join(phrases() + new(9) + p + new(9)))] if held_later else [(i, " ".join(phrases())) for i in range(12)]
    ids = list(range(20, 60))
    places = dict(zip(ids, rng.sample(range(400), len(ids)), strict=True))
    rows += [(i, " ".join(new(places[i]) + p + new(50))) for i in ids]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    spans = {}
    for r in got:
        spans.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert set(spans) == set(ids[0 if held_later else 1 :])
    assert all(spans[i] >= set(range(places[i], places[i] + 60)) for i in spans)


def test_passages_between_whose_holders_others_stand(spark):
    """Of each passage of fifty words smaller ids hold all phrases, and others, between its two holders, all parts of up to 45 words."""
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for base in range(0, 20000, 1000):
        p = new(50)
        rows += [(base + i, " ".join(new(9) + p[i : i + 9] + new(9))) for i in range(42)] + [(base + 100, " ".join(new(20) + p + new(20)))]
        rows += [(base + 200 + i, " ".join(new(9) + p[i : i + 45] + new(9))) for i in range(6)] + [(base + 300 + i, " ".join(new(9) + p[max(0, i - 22) : i + 22] + new(9))) for i in range(50)]
        rows.append((base + 900, " ".join(new(30) + p + new(30))))
        want[base + 900] = set(range(30, 80))
    spans = {}
    for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        spans.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
        assert r["match_id"] // 1000 == r["doc_id"] // 1000
    assert all(spans.get(i, set()) >= w for i, w in want.items())
    # each passage is told by one piece that an earlier document holds whole
    got = substring_dedup.matches(spark.createDataFrame(rows, "doc_id long, text string")).where("doc % 1000 = 900 and rdoc % 1000 = 100").count()
    assert got == len(want)


def test_windows_of_periodic_texts_are_covered():
    rng = np.random.default_rng(2)
    for period in (1, 2, 7, 25, 26, 49, 50, 60):
        text = np.concatenate((rng.integers(0, 1 << 32, 40), np.tile(rng.integers(0, 1 << 32, period), 400 // period), rng.integers(0, 1 << 32, 40))).astype(np.uint64)
        _, at, w = substring_dedup.window_rows([text, text], [substring_dedup.seeds(text)[0], np.zeros(0, np.int64)])
        h = substring_dedup._run_hashes(text) >> np.uint64(32)
        kept, every = {}, {}
        for x in range(len(text) - 49):
            off = int(h[x : x + 46].argmin())
            every.setdefault(text[x : x + 50].tobytes(), []).append(x)
            if x + off in set(at.tolist()):
                kept.setdefault(text[x : x + 50].tobytes(), []).append(x)
        assert len(set(w.tolist())) == len(every) and len(at) < len(every) + 2 * len(text) // 25 * min(period, 50)
        for k, places in every.items():
            assert {i for x in places for i in range(x, x + 50)} <= {i for x in kept[k] for i in range(x, x + 50)}


def test_holders_stream_over_batches(spark):
    """The pairs of seeds that go over many Arrow batches are those of one batch."""
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(30)]
    phrase = [rng.choice(vocab) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randrange(9)) + phrase[: rng.randrange(5, 40)] + rng.choices(vocab, k=5))) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pairs = lambda: {(r["doc"], r["rdoc"], tuple(sorted(map(tuple, r["m"])))) for r in substring_dedup.matches(docs).collect()}
    whole = pairs()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "3", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert pairs() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(whole) > 60


def test_pieces_by_hand():
    rng = np.random.default_rng(2)
    for trial in range(300):
        n, wide = int(rng.integers(0, 40)), 30 if trial % 2 else 400
        start = rng.integers(0, wide, n)
        end, holder = start + rng.integers(1, wide // 2, n), rng.integers(0, 8, n)
        pieces = list(zip(start.tolist(), end.tolist(), holder.tolist(), strict=True))
        want = [not any(h < m and a <= s and b >= e for a, b, h in pieces) for s, e, m in pieces]
        assert substring_dedup.first_held(start, end, holder).tolist() == want
        # a gap of up to 8 words is bridged
        covered = {w for s, e, _ in pieces for w in range(s, e + 8)}

        def words_around(s, at=covered):
            lo = hi = s
            while lo - 1 in at:
                lo -= 1
            while hi in at:
                hi += 1
            return hi - 8 - lo

        assert substring_dedup.long_spans(start, end, 50).tolist() == [words_around(s) >= 50 for s, _, _ in pieces]


def test_holders_of_a_hot_seed_make_chunks():
    rng = np.random.default_rng(1)
    h, doc = np.repeat(np.array([7, 9], np.uint64), (500, 3)), np.concatenate((rng.permutation(500), [1, 2, 3])).astype(np.int64)
    keys, ctx, doc, pos = substring_dedup._chunked(h, np.zeros(503, np.int32), doc, np.zeros(503, np.int32))
    assert len(keys) < 600 and (keys == 7).sum() < 20 and (keys == 9).sum() == 3
    order = np.lexsort((doc, keys))
    x, _, y, _ = substring_dedup.paired(keys[order], ctx[order], doc[order], pos[order])
    assert (x > y).all() and set(range(1, 500)) <= set(x.tolist())


def test_parts_of_a_chain_that_reach_the_identity():
    a = np.arange(300, dtype=np.uint16)
    b = np.concatenate((a[:60], 1000 + np.arange(14), a[60:120], 2000 + np.arange(90), a[120:180])).astype(np.uint16)
    chain = [(0, 0, 60), (60, 74, 60), (120, 224, 60)]
    assert substring_dedup.align(a, b, chain) == [(0, 120, 0, 134, 120), (120, 180, 224, 284, 60)]
    assert substring_dedup.align(a, b, chain[:2]) == [(0, 120, 0, 134, 120)]
    three = np.concatenate((a[:60], 1000 + np.arange(25), a[60:120], 2000 + np.arange(25), a[120:180])).astype(np.uint16)
    assert substring_dedup.align(a, three, [(0, 0, 60), (60, 85, 60), (120, 170, 60)]) == [(0, 120, 0, 145, 120), (60, 180, 85, 230, 120)]


@pytest.mark.parametrize("room", [1, 60, 1 << 20])
def test_words_of_many_texts_are_read_at_once(monkeypatch, room):
    texts = ["", "Ab c", " x", "y ", "é ü\u3000Z9-q", "", "a b c d e f " * 40, "\n", "one two " * 3, "a", ""]
    calls = []
    monkeypatch.setattr(substring_dedup, "_TEXTS", room)
    monkeypatch.setattr(substring_dedup.zlib, "crc32", lambda w, crc32=zlib.crc32: calls.append(w) or crc32(w))
    words = [[w for w in re.split(rb"[^0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())) if w] for t in texts]
    for array in (pa.array(texts), pa.array(["skipped", *texts, "too"])[1:-1]):
        got, seen = [], 0
        calls.clear()
        for i, codes, begin in substring_dedup.coded(array):
            assert i == seen and begin[-1] == len(codes)
            # each word is read once, however often it occurs
            assert sorted(calls) == sorted({w for t in words[i : i + len(begin) - 1] for w in t})
            calls.clear()
            got += [c.tolist() for c in np.split(codes, begin[1:-1])]
            seen += len(begin) - 1
        assert got == [[zlib.crc32(w) for w in t] for t in words]
        calls.clear()
    assert not list(substring_dedup.coded(pa.array([], pa.string())))


def test_seeds_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(5)
    tile = lambda n, times: np.tile(rng.integers(0, 1 << 32, n), times)
    texts = [rng.integers(0, 1 << 32, n) for n in (0, 3, 4, 5, 6, 50, 400, 0, 49, 2000)] + [tile(n, 60) for n in (1, 2, 7, 45, 47)] + [np.zeros(0, np.int64), rng.integers(0, 1 << 32, 7)]
    texts = [t.astype(np.uint64) for t in texts]
    begin = np.append(0, np.cumsum([len(t) for t in texts]))
    codes = np.concatenate(texts)
    at, h, text, repeats = substring_dedup._seeds(codes, begin)
    ctx = substring_dedup._context(codes, begin, at, text)
    assert repeats.any() and (np.diff(at) > 0).all()
    for k, one in enumerate(texts):
        edges, mine = np.array([0, len(one)]), text == k
        alone = substring_dedup._seeds(one, edges)
        assert [c[mine].tolist() for c in (h, repeats)] == [alone[1].tolist(), alone[3].tolist()] and (at[mine] - begin[k]).tolist() == alone[0].tolist()
        bit = lambda i, one=one: int(one[i]) >> 9 & 1 if 0 <= i < len(one) else 0
        want = [int("".join(str(bit(p + d)) for d in [*range(5, 21), *range(-1, -17, -1)]), 2) for p in alone[0].tolist()]
        assert ctx[mine].view(np.uint32).tolist() == want


def test_chains_of_one_run_are_aligned_together():
    rng = np.random.default_rng(3)
    pairs, at, runs = ([], []), [], []
    for trial in range(600):
        a = rng.integers(0, 1 << 20, int(rng.integers(5, 150)))
        cut = int(rng.integers(0, len(a)))
        b = np.concatenate((rng.integers(0, 1 << 20, int(rng.integers(0, 40))), a[cut:], rng.integers(0, 1 << 20, int(rng.integers(0, 40)))))
        b[rng.random(len(b)) < (0, 0.03, 0.1, 0.3)[trial % 4]] = 7
        before = len(b) - len(a[cut:]) if len(b) else 0
        y = int(rng.integers(0, before + 1))
        at.append([sum(map(len, p)) + e for p, e in ((pairs[0], 0), (pairs[0], len(a)), (pairs[1], 0), (pairs[1], len(b)))])
        x = cut if trial % 3 else int(rng.integers(0, len(a)))
        d = next((i for i in range(len(b)) if x < len(a) and b[i] == a[x]), y)
        runs.append((x, d, min(int(rng.integers(1, 60)), len(a) - x, len(b) - d)))
        pairs[0].append(a)
        pairs[1].append(b)
    found, told = substring_dedup.align_runs(*map(np.concatenate, pairs), np.array(at), *np.array(runs).T)
    want = [substring_dedup.align(a, b, [run]) for a, b, run in zip(*pairs, runs, strict=True)]
    assert 300 < told.sum() < 600
    assert all(w == [tuple(f)] for w, f, t in zip(want, found.tolist(), told, strict=True) if t)


def test_passages_of_an_id_that_has_two_texts(spark):
    """Seeds of a second text of an id may lie beyond the end of the first, which counts."""
    rng = random.Random(12)
    new = lambda n: ["z" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    p = new(60)
    rows = [(0, " ".join(new(20) + p))]
    for n in (0, 5, 9, 30, 33):
        rows += [(n + 1, " ".join(["a", *new(n)])), (n + 1, " ".join(new(30) + p + new(20)))]
    rows += [(100, " ".join(new(10) + p))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["match_id"], r["start"], r["end"]) for r in got] == [(100, 0, 10, 70)]


def test_fenwick_chain_is_the_best_chain():
    rng = random.Random(7)
    for _ in range(40):
        n = rng.randrange(1, 9)
        x, y = (np.array(sorted(rng.sample(range(0, 400, 7), n))), np.array(rng.sample(range(0, 400, 7), n)))
        runs = substring_dedup.diagonal_runs(x, y)
        runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))].tolist()
        best: dict[int, float] = {}
        for j, (a, b, w, c) in enumerate(runs):
            over = [best[i] - 0.1 * (a + b - (runs[i][0] + runs[i][2] - 4) - (runs[i][1] + runs[i][2] - 4)) for i in range(j) if runs[i][0] + runs[i][2] - 4 <= a and runs[i][1] + runs[i][2] - 4 <= b]
            best[j] = c + max([0.0, *over])
        chain = substring_dedup.chains(x, y)[0]
        covered = {(r[0], r[1]): r[3] for r in runs}
        total = sum(covered[a, b] for a, b, _ in chain) - 0.1 * sum(q[0] + q[1] - (p[0] + p[2] - 4) - (p[1] + p[2] - 4) for p, q in zip(chain, chain[1:], strict=False))
        assert total == pytest.approx(max(best.values()))


def test_every_window_of_runs_has_a_seed():
    codes = np.random.default_rng(0).integers(0, 1 << 32, 500).astype(np.uint64)
    at, _ = substring_dedup.seeds(codes)
    n = 500 - substring_dedup.K + 1
    assert all(((at >= i) & (at < i + substring_dedup.GAP)).any() for i in range(n - substring_dedup.GAP + 1))
    assert len(substring_dedup.seeds(np.ones(5000, np.uint64))[0]) < 1000


# decontamination


def test_item_windows_need_four_fifths(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    w = item.split()
    docs = [(1, f"x {item.upper()}, y"), (2, " ".join(w[:12])), (3, " ".join([*w[:10], "other", *w[10:]])), (4, " ".join([*w[:18], "b", "c"])), (5, "clean text")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), benchmark_of(spark, [(1, item), (2, "")])
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()} == {2, 3, 5}
    many = decontaminate.contamination_report(df, bench, block_bytes=1).orderBy("doc_id").collect()
    assert many == decontaminate.contamination_report(df, bench).orderBy("doc_id").collect()
    assert [r["n_hit"] for r in many] == [20, 12, 20, 18, 0]
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, bench, block_bytes=1).collect()} == {2, 3, 5}


def test_many_blocks_and_pieces_by_hand(spark, monkeypatch):
    rng = random.Random(20)
    word = lambda: rng.choice(NAMES)
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 40, 90])))) for i in range(60)] + [(3, "the cat"), (70, None), (None, "cat"), (71, " . ")]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 120)))) for i in range(60)]
    docs += [(100 + i, f"{docs[i][1]} {(items[i][1] or '').upper()}! x") for i in range(40)] + [(7, None), (7, docs[7][1]), (None, docs[8][1])]
    held = {}
    for i, t in items:
        w = (t or "").split() if i is not None else []
        w = [x for x in w if x != "."]
        held.setdefault(str(i), []).extend(tuple(w[j : j + min(10, len(w))]) for j in range(max(0, len(w) - 9) or 1) if w)
    want = []
    for i, t in docs:
        w = [x.lower() for x in re.findall(r"[A-Za-z0-9]+", t or "")]
        hit, found = set(), set()
        for item, windows in held.items():
            for p in windows:
                for j in range(len(w) - len(p) + 1):
                    if tuple(w[j : j + len(p)]) == p:
                        hit |= set(range(j, j + len(p)))
                        found.add(item)
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), benchmark_of(spark, items)
    scans = []
    plain = decontaminate._search
    monkeypatch.setattr(decontaminate, "_search", lambda *a: scans.append(a) or plain(*a))
    for block_bytes, piece in ((1 << 20, 1 << 13), (400, 1 << 13), (400, 7)):
        scans.clear()
        monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
        got = decontaminate.contamination_report(df, bench, block_bytes=block_bytes)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert (len(scans) == 1) == (block_bytes > 400)


# mixing


def test_raking_meets_margins_and_both_ways_agree(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["en", "en", "de"]), rng.choice(["s0", "s0", "s0", "s1", "s2"])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 0.4, "s1": 0.3, "s2": 0.3}, "lang": {"en": 0.5, "de": 0.5}}
    got = mixing.mixing_plan(df, rate=0.2, targets=targets).toPandas()
    tokens = got.n_tokens * got.prob
    for m, want in targets.items():
        share = tokens.groupby(got[m]).sum() / tokens.sum()
        assert all(abs(share[k] - v) < 1e-4 for k, v in want.items())
    assert abs((got.n_tokens * got.sampled).sum() / got.n_tokens.sum() - 0.2) < 0.05
    d = mixing.described(df)[0]
    for want in (targets, {"source": {"s0": 0.0, "s1": 0.9, "s2": 0.1}}):  # the second is out of reach
        a = mixing.cell_probabilities(d, 0.2, targets=want)[0].toPandas().set_index(list(mixing.MARGINS)).p
        b = mixing.cell_probabilities(d, 0.2, targets=want, driver_cells=1)[0].toPandas().set_index(list(mixing.MARGINS)).p
        assert len(a) == len(b) and (a - b.reindex(a.index)).abs().max() < 1e-9
    assert not mixing.reached_margins(mixing.mixing_plan(df, rate=0.2, targets=targets), 0.2, targets=targets).where("missed").count()
    far = mixing.reached_margins(mixing.mixing_plan(df, rate=0.6, targets=want), 0.6, targets=want).where("margin = 'source'").toPandas().set_index("category")
    assert far.missed["s1"] and far.target["s1"] == 0.9 and far.reached["s1"] < 0.9


@tables
def test_plan_of_the_tables_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    plan = QUERIES["op5_mixing"](spark, SF).toPandas().set_index("doc_id")
    assert sorted(plan.index) == sorted(docs.index)
    assert all(plan.n_tokens[i] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs.text.items())
    assert (plan.source == docs.source.fillna("(none)")[plan.index]).all() and (plan.lang == docs.lang.fillna("(none)")[plan.index]).all()
    assert plan.topic.nunique() > 2 and ((plan.topic == "(none)") == (plan.n_tokens == 0)).all()
    # plain raking, cell by cell, to the same end
    cells = {k: float(v) for k, v in plan.groupby(["source", "lang", "topic"]).n_tokens.sum().items()}
    whole, p = sum(cells.values()), dict.fromkeys(cells, 0.4)
    for _ in range(2000):
        for m in range(3):
            sums: dict[str, float] = {}
            have: dict[str, float] = {}
            for k, t in cells.items():
                sums[k[m]] = sums.get(k[m], 0.0) + t
                have[k[m]] = have.get(k[m], 0.0) + t * p[k]
            power = {c: t**0.8 for c, t in sums.items() if t}
            share = {c: x / sum(power.values()) for c, x in power.items()}
            p = {k: min(1.0, v * share.get(k[m], 0.0) * 0.4 * whole / have[k[m]]) if have[k[m]] else v for k, v in p.items()}
    assert all(abs(r.prob - p[r.source, r.lang, r.topic]) < 0.01 for r in plan.itertuples())
    assert abs((plan.n_tokens * plan.sampled).sum() / whole - 0.4) < 0.1


def test_topics_follow_the_words(spark):
    rng = random.Random(12)
    themes = [["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(30)] for _ in range(4)]
    rows = [(i, " ".join(rng.choice(themes[i % 4]) if rng.random() < 0.7 else rng.choice(NAMES) for _ in range(80)), "en", "s") for i in range(200)]
    got = mixing.mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    purity = sum(got[got.topic == t].doc_id.mod(4).value_counts().max() for t in got.topic.unique()) / len(got)
    assert purity > 0.95


# quality


@tables
def test_classifier_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = cotraining.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()) > 0.9


def test_no_labels_say_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert cotraining.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int")).first()["score"] == pytest.approx(0.5)


# chat


def test_trees_are_ranked_and_read_back(spark):
    tree = [("c", 1, None, "user", "hi </turn>\n### Assistant: ok ##", 0.0), ("c", 2, 1, "assistant", "one\\", 1.0), ("c", 3, 1, "assistant", "two", 2.0), ("c", 4, 3, "user: ", None, 0.5), (None, 1, None, None, "\\", None)]
    df = spark.createDataFrame(tree, "conv string, node long, parent long, role string, text string, score double")
    out = chat.format_conversations(df, top=2).orderBy("conv", "rank").withColumn("t", chat.read_back(F.col("formatted"))).collect()
    read = [(r["conv"], r["leaf"], [tuple(x) for x in r["t"]]) for r in out]
    assert read == [
        (None, 1, [("", "\\")]),
        ("c", 4, [("user", tree[0][4]), ("assistant", "two"), ("user: ", "")]),
        ("c", 2, [("user", tree[0][4]), ("assistant", "one\\")]),
    ]
    two = out[1]
    start, size = two["loss_spans"][0]
    assert len(two["loss_spans"]) == 1 and two["formatted"][start : start + size] == "two"


def test_cycles_raise_and_odd_conversations_are_whole(spark):
    kinds = "conv string, node long, parent long, role string, text string, score double"
    with pytest.raises(ValueError, match="cycle"):
        chat.paths(spark.createDataFrame([("c", 1, 2, "u", "a", 0.0), ("c", 2, 1, "u", "b", 0.0), ("c", 3, 2, "u", "c", 0.0)], kinds)).count()
    assert chat.paths(spark.createDataFrame([("c", 1, 2, "u", "a", 0.0), ("c", 2, 1, "u", "b", 0.0)], kinds)).count() == 0
    rows = [(1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (1, 0, "user", "b", 1), (None, None, None, None, 1), (2, 5, "assistant", None, 1)]
    many = "conv_id long, turn long, role string, text string, node long"
    got = chat.conversation_digests(chat.format_conversations(chat.chain_by_turn(spark.createDataFrame(rows, many)))).collect()
    assert sorted(((r["conv_id"], r["n_turns"]) for r in got), key=str) == [(1, 3), (2, 1), (None, 1)]
    assert chat.conversation_digests(chat.format_conversations(chat.chain_by_turn(spark.createDataFrame([], many)))).count() == 0
    tie = [("c", 1, None, "user", "q", 0.0), ("c", 3, 1, "assistant", "late", 1.0), ("c", 2, 1, "assistant", "first", 1.0)]
    assert [r["leaf"] for r in chat.format_conversations(spark.createDataFrame(tie, kinds), top=2).orderBy("rank").collect()] == [2, 3]


@pytest.mark.parametrize("n", [1, 33, 1025])
def test_long_chains_are_whole(spark, n):
    rows = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('m', id) AS text")
    got = chat.conversation_digests(chat.format_conversations(chat.chain_by_turn(rows))).collect()
    told = "".join(f"{'user' if i % 2 == 0 else 'assistant'}\nm{i}\n" for i in range(n))
    assert [(r["n_turns"], r["turns_sha256"]) for r in got] == [(n, hashlib.sha256(told.encode()).hexdigest())]


def test_time_follows_the_turns_of_one_conversation(spark):
    """Eight times the turns take some eight times as long, not the square; spans hold what they should."""
    import time

    def tree(n):
        return spark.range(n).select(F.lit("c").alias("conv"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é#"), F.repeat(F.lit("word "), 60), F.col("id").cast("string")).alias("text"), F.lit(0.0).alias("score"))

    took = {}
    for n in (1000, 1000, 8000):  # the first compiles
        path = tree(n).select("conv", F.lit("c").alias("ck"), F.lit(n - 1).alias("leaf"), "node", (n - 1 - F.col("node")).alias("up"))
        with pytest.MonkeyPatch.context() as m:
            m.setattr(chat, "paths", lambda _, path=path: path)
            began = time.time()
            r = chat.conversation_digests(chat.format_conversations(tree(n))).first()
            took[n] = time.time() - began
        lost = "".join(f"é#{'word ' * 60}{i}" for i in range(1, n, 2))
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (n, len(lost), hashlib.sha256(lost.encode()).hexdigest())
    assert took[8000] < 16 * took[1000] + 4
    assert "aggregate(" not in chat.format_conversations(tree(3))._jdf.queryExecution().optimizedPlan().toString()


# pages


PAGES = [
    ("<body><nav><a href=x>menu</a></nav><article><h1>T &amp; U</h1><p>One,<b> two</b>.<p>Three</article><footer>f</footer>", "T & U One, two. Three"),
    ("<article><p>Kept</p><form><p>ask</p></form><div class='comments'><p>first, nice, post</p></div><aside>side</aside></article>", "Kept"),
    ("<div id='cookie-notice'><p>We, use, cookies</p></div><div><p>Long, text, here.</p><p>More, text.</p></div>", "Long, text, here. More, text."),
    ("<article><p>a<script>if (1 < 2) '</article>'</script>b<style>p{}</style> <!-- no -->c&nbsp;d</p><p>cut o", "ab c d cut o"),
    ("<ul><li><a href=a>x</a></li></ul><div><h2>H</h2><p>Body, of, the page</p><ul><li>one<li>two</ul></div>", "H Body, of, the page one two"),
    ("<div class='page with-sidebar'><div class='header'><p>Site, name</p></div><main><article><header><h1>T</h1></header><p>A, b.</p><section class='comments'><article><p>reader, said</p></article></section></article><div class='related'><p>More</p></div></main></div>", "T A, b."),
    ("<div class='post'><p>Body, text, of this page.</p></div><div id='comments'><article><p>a, b, c, d, e, f</p></article></div>", "Body, text, of this page."),
    ("<article class='post comments-open no-sidebar'><p>Words, in, a post</p></article><article class='comment'><p>c, c, c, c, c, c, c, c</p></article>", "Words, in, a post"),
    ("<main><article><p>one, two, three</p></article><p>promo</p></main>", "one, two, three"),
    ("<article><p>One</p><p class='related-work'>Two</p><p id='notice-of-change'>Three</p><p>x <math><mi>a</mi><mo>+</mo><mi>b</mi></math></p><xmp>if <a> &amp; b</xmp></article>", "One Two Three x a+b if <a> &amp; b"),
    ("<article><p>One</p><div class='related-work'><p>Kept, prose</p></div><div class='related-reading'><a href=x>Link</a> <a href=y>Link</a></div><div class='search-tips'>Ask <input name=q></div></article>", "One Kept, prose"),
    ("<article><p>One</p><p class='ad'>Buy</p><div class='ad-slot'>Buy</div><div class='cookieBanner'>We use</div><section id='post-comments'><p>reader</p></section><pre><span class='hljs-comment'># note</span> <span class='comment'># two</span></pre></article>", "One # note # two"),
    ("<article><p class='hidden-gems menu-prices'>Kept</p><svg><text>label</text></svg><canvas>drawn</canvas></article>", "Kept labeldrawn"),
    ("<div class='search results'><p title='a hidden b'>Odd, class.</p><p>But, text.</p></div>", "Odd, class. But, text."),
    ("<article><p id='cookies'>Section about cookies in baking, and more.</p><p class='cookies'>We use them</p></article>", "Section about cookies in baking, and more."),
    ("<body><div id='search'><p>One paragraph, of text.</p><p>And another, too.</p></div></body>", "One paragraph, of text. And another, too."),
    ("<div><p>First, part of it.</p></div><div><p>Second, part of it.</p></div>", "First, part of it. Second, part of it."),
    ("<h1>Title</h1><div id=content><p>A, b, c, d.</p><p>E, f, g, h.</p><p>I, j.</p></div><p>After.</p><div class='story-tail'><p>The tail</p></div>", "Title A, b, c, d. E, f, g, h. I, j. After. The tail"),
    ("<body><p>Intro</p><div><p>A, long, one here.</p><p>Two, of them.</p></div><ul><li><a href=x>more</a></ul><div><p>Join us</p><input name=q></div></body>", "Intro A, long, one here. Two, of them."),
    ("<div style='display:none'><p>Hidden, long, text, of, many, commas</p></div><div><p>Seen</p></div>", "Seen"),
    ("<div class='sidebar'><p>Much longer, than, the article</p><p>and more, text</p></div><article><p>Short</p></article>", "Short"),
    ("", ""), (None, ""), ("<p></p>", ""), ("5 < 6 & 7 > 3", "5 < 6 & 7 > 3"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_main_text(html, text):
    assert html_extract.extract(html) == text


def _made_page(rng, wrap):
    """A page with menus, adverts, notices, forms, comments and other parts around an article of known text."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    say = lambda n: ", ".join(" ".join(word() for _ in range(rng.randrange(3, 9))) for _ in range(n)) + "."
    links = lambda n: "".join(f"<li><a href='/{word()}'>{word()} {word()}</a></li>" for _ in range(n))
    junk = [
        lambda: f"<nav><ul>{links(5)}</ul></nav>", lambda: f"<div class='{rng.choice(['ad', 'ad-slot top', 'sponsored-box', 'cookie-banner', 'newsletter-signup'])}'><p>{say(2)}</p></div>",
        lambda: f"<form><p>{say(1)}</p><input name=q></form>", lambda: f"<aside><p>{say(2)}</p></aside>", lambda: "<script>if (1 < 2) '<p>no</p>'</script>",
        lambda: f"<div id='comments' class='comment-list'><article class='comment'><p>{say(3)}</p></article></div>", lambda: f"<div class='more-{word()} related-{word()}'><ul>{links(4)}</ul></div>",
    ]
    blocks, want = [], []
    for _ in range(rng.randrange(3, 12)):
        t, kind = say(rng.randrange(1, 6)), rng.choice(["p", "p", "p", "p class='related-work lead'", "h2", "blockquote", "div class='text-block'", "p id='notice-of-change'"])
        shown = t.replace(",", "&#44;", 1) if rng.random() < 0.3 else t
        shown = f"{shown[:5]}<b>{shown[5:9]}</b>{shown[9:]}" if "&" not in shown and rng.random() < 0.3 else shown
        blocks.append(f"<{kind}>{shown}</{kind.split()[0]}>" if rng.random() < 0.8 or kind != "p" else f"<p>{shown}\n")
        want.append(t)
        if rng.random() < 0.3:
            blocks.append(rng.choice(junk)())
    head = f"<h1>{say(1)}</h1>"
    want.insert(0, head[4:-5])
    body = wrap.format(head + "".join(blocks))
    page = f"<html><head><title>{word()}</title><style>p{{}}</style></head><body><header><p>{say(1)}</p></header>{''.join(rng.choice(junk)() for _ in range(3))}{body}{rng.choice(junk)()}<footer>{say(1)}</footer></body></html>"
    return page, " ".join(" ".join(want).split())


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article class='post no-sidebar'>{}</article></main>", "<div>{}</div>", "<div class='story-7 entry'><div>{}</div></div>", "<section id='content'>{}</section>"])
def test_made_pages_by_construction(wrap):
    rng = random.Random(wrap)
    for _ in range(60):
        page, want = _made_page(rng, wrap)
        assert html_extract.extract(page) == want


@tables
@pytest.mark.parametrize("tag", ["div", "section"])
def test_scores_alone_find_the_articles(tag):
    import pandas as pd

    for html in pd.read_parquet(f"{SF}/pages.parquet").html[:200]:
        bare = html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")
        assert html_extract.extract(bare) == html_extract.extract(html)


def test_repeated_pages_and_extra_columns(spark):
    rows = [(1, "u", "<article><p>a</p></article>", "x"), (1, "u", "<article><p>a</p></article>", "x"), (None, None, None, None)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(tuple(r) for r in got if r["page_id"]) == [(1, "u", "a", 1)] * 2 and len(got) == 3


def test_page_rows(spark):
    rows = [(i, None if i % 2 else "u", h) for i, (h, _) in enumerate(PAGES)]
    got = {r["page_id"]: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [(got[i]["text"], got[i]["n_chars"]) for i in range(len(PAGES))] == [(t, len(t)) for _, t in PAGES]
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# licences


def test_licences_inside_other_words(spark):
    rng = random.Random(6)
    noise = lambda n: " ".join(rng.choice(NAMES) for _ in range(n))
    mit = TEMPLATES["mit"].split()
    cut = " ".join(w for i, w in enumerate(mit) if i not in (20, 90))
    rows = [(1, f"{noise(37)} {TEMPLATES['mit']} {noise(11)}"), (2, f"{noise(5)} {cut}"), (3, " ".join(mit[:60])), (4, noise(300)), (5, f"{noise(3)}, RELEASED under\nthe MIT license! {noise(9)}"), (6, f"license {noise(50)} released")]
    got = {(r["doc_id"], r["license"]): r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), TEMPLATES).collect()}
    assert set(got) == {(1, "mit"), (2, "mit"), (5, "mit-line")}
    assert got[1, "mit"]["containment"] == 1 and 0.8 <= got[2, "mit"]["containment"] < 1 and got[5, "mit-line"]["first_word"] == 3
    assert license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), {}).count() == 0

"""The corpus pipeline: stage order, columns, whole rows, and planted cases."""

import random
from pathlib import Path

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_planted_cases(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    clean = [" ".join(word() for _ in range(150)) for _ in range(40)]
    item = " ".join(word() for _ in range(40))
    passage = " ".join(word() for _ in range(70))
    rows = list(enumerate(clean)) + [(100, clean[3]), (101, clean[4].replace(clean[4].split()[75], "edited", 1)), (102, f"{clean[5][:60]} {item} {clean[6][:80]}"), (103, "12 !!"), (104, None), (105, ""), (106, f"{' '.join(word() for _ in range(80))} {passage}"), (107, f"{passage} {' '.join(word() for _ in range(80))}")]
    docs = spark.createDataFrame([(i, t, "aa", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept["language"]) == {i for i, t in rows if i not in (103, 104, 105)}
    assert set(kept["language"]) - set(kept["near_duplicates"]) == {100, 101}
    cut = kept["repeated_passages"]
    assert set(cut) == set(kept["near_duplicates"]) and passage in cut[106] and passage[:100] not in cut[107]
    assert all(cut[i] == clean[i] for i in range(40))
    assert set(cut) - set(kept["benchmark_leaks"]) == {102}
    assert set(kept["mixture"]) <= set(kept["benchmark_leaks"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["mixture"])


def test_empty_tables_and_null_ids(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, rows in (("none", []), ("odd", [(None, "some words of a text", None, None, None), (1, None, "en", "s", 0), (2, "other words of a text", "en", None, None)])):
        docs = spark.createDataFrame(rows, kinds)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[:5] == docs.columns and out.count() <= len(rows), name


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
def test_runs_over_the_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < 200 and [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "benchmark_leaks", "mixture"]

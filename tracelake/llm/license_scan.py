"""License scans with DataFrame functions only.

A text is cut into overlapping word windows, one set for each template length m: stride max(1, m // 4), size m + stride
- 1, so that every run of m words lies whole in some window. A window and a template of which it holds a share c of the
shingles have a Jaccard similarity J of at least c*k / (k + stride - 1 + (1-c)*k) for k = m - SHINGLE + 1. One
MinHash is a band; with B bands such a pair meets with probability 1 - (1-J)^B, over 1 - 3e-6 at c = 0.8 and B = 16.
Windows that meet a template in a band are then verified by exact containment of its word shingles.

Before that, texts that cannot hold any template are left out without loss: words are picked from each template
until over a share 1-c of its shingles hold one of them, so a text without any of these words misses more shingles of
every template than a match may.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 16
#: Templates of up to so many words together are broadcast (their shingles take about 40 MB in all bands); more are joined by a shuffle.
BROADCAST_WORDS = 50_000
_WORD = re.compile(r"[a-z0-9]+")


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, words): templates as a table."""
    rows = [(k, _WORD.findall(v.lower())) for k, v in sorted(templates.items())]
    return spark.createDataFrame([r for r in rows if r[1]], "license string, words array<string>")


def gate_words(templates: dict[str, str], shingle: int = SHINGLE, containment: float = CONTAINMENT) -> list[str]:
    """Words of which every text that contains a template must hold one: long words first, as they are rarer."""
    picked: set[str] = set()
    for text in templates.values():
        words = _WORD.findall(text.lower())
        size = min(shingle, len(words))
        own = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
        may_miss = len(own) - math.ceil(containment * len(own) - 1e-9)
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            if sum(1 for s in own if not picked.isdisjoint(s)) > may_miss:
                break
            picked.add(w)
    return sorted(picked)


def shingles(words: Column, size: Column) -> Column:
    """Distinct runs of so many words, as strings; the whole if it has fewer words."""
    n = F.greatest(F.size(words) - size + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, size), " ")))


def _runs(k: int) -> Column:
    """A hash of every run of k words."""
    return F.transform(F.sequence(F.lit(1), F.size("words") - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice("words", i, F.lit(k)), " ")))


def _permuted(hashes: str, band: int) -> Column:
    return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band)))


def minhashes(items: Column, bands: int) -> Column:
    """One MinHash a band of an array of strings."""

    def one(band: int) -> Column:
        return F.array_min(F.transform(items, lambda x: F.xxhash64(F.xxhash64(x), F.lit(band))))

    return F.array(*[one(b) for b in range(bands)])


def license_scan(
    docs: DataFrame,
    templates: dict[str, str],
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    containment: float = CONTAINMENT,
    bands: int = BANDS,
) -> DataFrame:
    """(doc_id, license, containment, first_word, n_windows): one row for each id and licence that its whole text holds.

    Words are runs of a-z and 0-9 in the lower-cased text. A template of fewer words than a shingle is one shingle.
    containment: the largest share of a template's distinct shingles in one window; first_word: where the first window
    with that share starts; n_windows: windows at or above the limit. Null and empty texts hold nothing; rows that
    repeat an id count as one document; a null id is reported as null; no templates give an empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession
    by_size: dict[int, list[str]] = defaultdict(list)
    for name, text in templates.items():
        if n := len(_WORD.findall(text.lower())):
            by_size[n].append(name)
    low = F.lower(F.col(text_col))
    may = F.lit(False)
    for w in gate_words(templates, shingle, containment):
        may = may | low.contains(w)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    held = docs.where(may).select(F.col(id_col).alias("doc_id"), words.alias("words")).where(F.size("words") > 0)
    if not by_size:
        return held.where("false").selectExpr("doc_id", "'' AS license", "0D AS containment", "0L AS first_word", "0L AS n_windows")

    # every shingle is hashed once, and once a band; windows then only take minima
    kinds = sorted({min(shingle, m) for m in by_size})
    for k in kinds:
        held = held.withColumn(f"h{k}", F.when(F.size("words") >= k, _runs(k)).otherwise(F.array().cast("array<bigint>")))
    for k in kinds:
        held = held.withColumn(f"b{k}", F.array(*[_permuted(f"h{k}", b) for b in range(bands)])).drop(f"h{k}")

    table = template_table(spark, templates).withColumn("m", F.size("words"))
    signed = table.withColumn("ts", shingles(F.col("words"), F.least(F.lit(shingle), F.col("m")))).drop("words").withColumn("h", minhashes(F.col("ts"), bands))
    keyed = signed.select("m", "license", "ts", F.posexplode_outer("h").alias("band", "v"))
    small = sum(n * len(names) for n, names in by_size.items()) <= BROADCAST_WORDS
    # the values of a small collection, a few numbers a template, let windows without any band in common go at once
    wanted = sorted({v for r in signed.select("h").collect() for v in r["h"]}) if small else None

    def windows(m: int) -> Column:
        stride, k = max(1, m // 4), min(shingle, m)
        size = m + stride - 1
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - m, F.lit(0)) + (stride - 1), F.lit(stride))
        low = lambda s: F.array(*[F.array_min(F.slice(F.get(f"b{k}", F.lit(b)), s + 1, F.lit(size - k + 1))) for b in range(bands)])
        signed = F.transform(starts, lambda s: F.struct(F.lit(m).alias("m"), s.alias("start"), low(s).alias("h")))
        if wanted is not None:
            signed = F.filter(signed, lambda x: F.exists(x["h"], lambda v: v.isin(*wanted)))
        return F.transform(signed, lambda x: F.struct(x["m"].alias("m"), x["start"].alias("start"), x["h"].alias("h"), F.slice("words", x["start"] + 1, F.lit(size)).alias("w")))

    cut_up = held.select("doc_id", F.explode_outer(F.concat(*[windows(m) for m in sorted(by_size)])).alias("x")).where(F.col("x").isNotNull()).select("doc_id", "x.*")
    spread = cut_up.select("doc_id", "m", "start", "w", F.posexplode_outer("h").alias("band", "v"))
    pairs = spread.join(F.broadcast(keyed) if small else keyed, ["m", "band", "v"])
    own = shingles(F.col("w"), F.least(F.lit(shingle), F.col("m")))
    share = F.size(F.array_intersect(own, F.col("ts"))) / F.size("ts")
    exact = pairs.select("doc_id", "license", "start", share.alias("share")).where(F.col("share") >= containment - 1e-9).distinct()
    return exact.groupBy("doc_id", "license").agg(
        F.max("share").alias("containment"),
        F.min_by("start", F.struct(-F.col("share"), F.col("start"))).cast("long").alias("first_word"),
        F.countDistinct("start").alias("n_windows"),
    )

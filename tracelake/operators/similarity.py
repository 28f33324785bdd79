"""Similarity of vectors and hashes, and segmentation of ordered sequences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.operators.relational import islands
from tracelake.session import cut, share_code


def sign_hash(vector: str, bits: int = 63) -> Column:
    """A long with a bit for each of the first positive components."""
    one = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i)).otherwise(F.lit(0).cast("long"))
    return reduce(lambda a, b: a + b, [one(i) for i in range(bits)])


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def scenes(frames: DataFrame, stream: str, order: str, code: str, bits: int) -> DataFrame:
    """(stream, scene, start, end, members, max_change, settled): a scene starts where the hash changes by bits or more.

    settled is the member that changed least against the one before it, the last of such.
    """
    w = W.partitionBy(stream).orderBy(order)
    t = frames.withColumn("_before", F.lag(code).over(w)).withColumn("_change", F.bit_count(F.col(code).bitwiseXOR(F.col("_before"))))
    t = islands(t, [stream], [order], F.col("_change") >= bits, "scene")
    calm = F.when(F.col("_change") < bits, F.struct((-F.col("_change")).alias("c"), F.col(order).alias("o")))
    return t.groupBy(stream, "scene").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("members"), F.max("_change").alias("max_change"), F.coalesce(F.max(calm)["o"], F.min(order)).alias("settled"))


def refine(found: DataFrame, frames: DataFrame, extra: DataFrame, stream: str, order: str, code: str, bits: int, top: int) -> DataFrame:
    """Scenes anew after the top busiest ones of every stream get extra frames."""
    busy = found.withColumn("_r", F.row_number().over(W.partitionBy(stream).orderBy(F.desc("members"), "scene"))).where(F.col("_r") <= top)
    more = extra.join(busy.select(F.col(stream).alias("_s"), "start", "end"), (F.col(stream) == F.col("_s")) & F.col(order).between(F.col("start"), F.col("end")), "left_semi")
    return scenes(frames.unionByName(more), stream, order, code, bits)


def attach(points: DataFrame, found: DataFrame, stream: str, at: str) -> DataFrame:
    """points with the scene of their stream that holds them: the last that started at or before, if it has not ended."""
    from tracelake.operators.relational import asof_join

    j = asof_join(points, found.select(stream, F.col("start").alias("_start"), "scene", "end"), stream, at, "_start", ["scene", "end"])
    return j.withColumn("scene", F.when(F.col(at) <= F.col("end"), F.col("scene"))).drop("end")


def similar(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 2048) -> DataFrame:
    """(query, key, cosine): the k vectors nearest to each query vector, by exact cosine.

    Queries go out in blocks of bounded size; each task multiplies its rows with a block and keeps its own k best for
    every query, so what is shuffled is k rows a query and task. Null and zero vectors match nothing; no queries give an
    empty result. Keys are whole numbers.
    """
    share_code(df.sparkSession)
    wanted = queries.select(F.col(key).alias("q"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    n = max(1, -(-wanted.count() // block))
    parts = []
    for b in range(n):
        rows = wanted.where(F.pmod(F.xxhash64("q"), F.lit(n)) == b).collect()
        if not rows:
            continue
        ids, m = np.array([r["q"] for r in rows]), np.array([r["v"] for r in rows], np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        ids, m = ids[norm[:, 0] > 0], (m / np.where(norm > 0, norm, 1))[norm[:, 0] > 0]
        shared = df.sparkSession.sparkContext.broadcast((ids, m))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qs, qm = shared.value
            best = [np.zeros((len(qs), 0), np.int64), np.zeros((len(qs), 0))]
            for pdf in frames:
                pdf = pdf[pdf["v"].notna()]
                if len(pdf) == 0:
                    continue
                x = np.array(pdf["v"].tolist(), np.float64)
                size = np.linalg.norm(x, axis=1)
                x, keys = x[size > 0] / size[size > 0, None], pdf["k"].to_numpy()[size > 0]
                score = np.concatenate([best[1], qm @ x.T], axis=1)
                keys = np.concatenate([best[0], np.broadcast_to(keys, (len(qs), len(keys)))], axis=1)
                order = np.lexsort((keys, -np.round(score, 12)), axis=1)[:, :k]
                best = [np.take_along_axis(keys, order, 1), np.take_along_axis(score, order, 1)]
            have = best[0].shape[1]
            yield pd.DataFrame({"query": np.repeat(qs, have), "key": best[0].ravel(), "cosine": best[1].ravel()})

        parts.append(df.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, "query long, key long, cosine double"))
    if not parts:
        return df.sparkSession.createDataFrame([], "query long, key long, cosine double")
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("cosine", 12)), "key"))).where(F.col("_r") <= k).drop("_r")


#: Codes in a block of which all pairs are compared.
BLOCK = 1 << 14


def _pairs_in_blocks(one: DataFrame, radius: int) -> DataFrame:
    """(a, b, bits): pairs of the distinct codes of one (key, c) within a radius, each code compared with every other.

    Codes are dealt into blocks of bounded size by a hash; every two blocks, and each with itself, are one row that a task
    compares in slices.
    """
    share_code(one.sparkSession)
    one = cut(one)
    blocks = max(1, -(-one.count() // BLOCK))
    packed = one.groupBy(F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("_b")).agg(F.collect_list(F.struct("key", "c")).alias("_r"))
    packed = cut(packed.select("_b", F.col("_r.key").alias("k"), F.col("_r.c").alias("c")))
    parts = min(2000, blocks * (blocks + 1) // 2)
    x = packed.select(F.col("_b").alias("i"), F.explode(F.sequence("_b", F.lit(blocks - 1))).alias("j"), F.col("k").alias("ka"), F.col("c").alias("ca")).repartition(parts, "i", "j")
    y = packed.select(F.explode(F.sequence(F.lit(0), "_b")).alias("i"), F.col("_b").alias("j"), F.col("k").alias("kb"), F.col("c").alias("cb")).repartition(parts, "i", "j")
    key = one.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(0)[row].as_py() == batch.column(1)[row].as_py()
                ka, ca, kb, cb = (batch.column(n)[row].values for n in range(2, 6))
                m, n = ca.to_numpy().view(np.uint64), cb.to_numpy().view(np.uint64)
                for at in range(0, len(m), 16):
                    bits = np.bitwise_count(m[at : at + 16, None] ^ n)
                    p, q = np.nonzero(bits <= radius)
                    if same:
                        p, q = p[p + at < q], q[p + at < q]
                    if len(p):
                        yield pa.RecordBatch.from_arrays([ka.take(pa.array(p + at)), kb.take(pa.array(q)), pa.array(bits[p, q].astype(np.int32))], names=["x", "y", "bits"])

    met = x.hint("merge").join(y, ["i", "j"]).select("i", "j", "ka", "ca", "kb", "cb").mapInArrow(run, f"x {key}, y {key}, bits int")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "bits")


def near_dupes(df: DataFrame, key: str, code: str, radius: int, width: int = 64) -> DataFrame:
    """(a, b, bits): pairs of distinct codes within a radius, each by its least key; and every other row of a code with its least key, at 0 bits.

    The width bits are cut in radius + 1 bands; codes within the radius agree in one band at least, the join key. Bands
    of so few bits that they leave more than one pair in a thousand tell too little: then all codes are compared, in blocks.
    """
    one = df.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("c")).agg(F.min(key).alias("key"))
    copies = df.select(F.col(key).alias("b"), F.col(code).alias("c")).join(one.select(F.col("key").alias("a"), "c"), "c").where("a <> b").select("a", "b", F.lit(0).alias("bits"))
    size = -(-width // (radius + 1))
    if (radius + 1) / 2**size > 1e-3:
        return _pairs_in_blocks(one.select("key", F.col("c").cast("long").alias("c")), radius).unionByName(copies)
    bands = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("c", i * size).bitwiseAND(F.lit((1 << size) - 1)).alias("part")) for i in range(radius + 1)]
    t = one.select("key", "c", F.explode(F.array(*bands)).alias("x")).select("key", "c", "x.*")
    j = t.select(F.col("key").alias("a"), F.col("c").alias("ca"), "band", "part").join(t.select(F.col("key").alias("b"), F.col("c").alias("cb"), "band", "part"), ["band", "part"])
    bits = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")))
    return j.where((F.col("a") < F.col("b")) & (bits <= radius)).select("a", "b", bits.alias("bits")).distinct().unionByName(copies)

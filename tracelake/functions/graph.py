"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.session import cut, share_code

#: Edges up to which a graph is settled in one task, in some 20 MB; larger ones take rounds of joins.
SMALL = 1 << 18


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the smallest of their component, and the smallest."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        if (low == root[x]).all() and (low == root[y]).all():
            break
        # the roots of both ends hang on the smaller one, then every node on the root of its root
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root != root[root]).any():
            root = root[root]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[hung], nodes[root[hung]]


def _flat(edges: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root on anything."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select(F.col("b").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    g = ends.groupBy("u").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    return not g.agg(F.bool_or((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0))).first()[0]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, root): root is the smallest node of the component, for every node that has an edge and is not the root.

    A graph of up to small edges is settled at once. Beyond that, large-star and small-star rounds: each round hangs neighbours on the smallest node seen, so chains shrink
    geometrically and no task ever holds a component. The edge table is checkpointed each round and the loop ends when
    all nodes hang on their root. Self-loops and repeated edges are ignored; edges with a null end are ignored; an empty
    edge table gives an empty result. Raises if max_rounds do not reach the fixed point.
    """
    cur = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    if cur.count() <= small and [t for _, t in cur.dtypes] == ["bigint", "bigint"]:
        share_code(cur.sparkSession)

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [[b.column(i).to_numpy() for i in (0, 1)] for b in batches]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots_of(*map(np.concatenate, zip(*parts, strict=True)))], names=["node", "root"])

        return cut(cur.coalesce(1).mapInArrow(settle, "node long, root long"))
    for _ in range(max_rounds + 1):
        if _flat(cur):
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        cur = cut(small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

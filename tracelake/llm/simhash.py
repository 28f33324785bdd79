"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A fingerprint has 64 bits. For radius r a random map gives every bit position a vector in GF(2)^(r+1). Each non-zero
v in that space names one table, whose mask keeps the positions with <m(position), v> = 1. The at most r positions in
which two fingerprints differ span at most r dimensions, so some v is orthogonal to all of them: its mask hides every
difference and the pair meets in that table. 2^(r+1)-1 tables thus find every pair within the radius, with no misses.

A bucket is not compared all with all. Its members within the radius of the one that meets most others are linked to
that; then only members of different groups are left to compare. Where those are many, the bucket is divided: its members agree on all
bits that its mask shows, so a second family of masks over the hidden bits alone covers every pair in it again, and a
third one after that. A bucket of the last level agrees on all but some eight bits, which bounds it, whatever the data.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.graph import connected_components
from tracelake.session import cut, free_names, measured, share_code

BITS = 64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CHUNK = 1 << 15


def covering_masks(radius: int, seed: int = 11) -> list[int]:
    """Signed 64-bit masks, one per non-zero vector of GF(2)^(radius+1).

    Positions are dealt over the non-zero vectors as evenly as they go, so that no mask keeps few bits; zero vectors
    would hide a position in every table and are not used.
    """
    top = 1 << (radius + 1)
    rng = random.Random(seed)
    vectors: list[int] = []
    while len(vectors) < BITS:
        deal = list(range(1, top))
        rng.shuffle(deal)
        vectors += deal
    out = []
    for v in range(1, top):
        mask = sum(1 << i for i in range(BITS) if (vectors[i] & v).bit_count() % 2)
        out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned fingerprint of one whole text: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones, hashed = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    for at in range(0, n, _CHUNK):
        h = np.array([hashed(line[i:j], 42) for i, j in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per row of docs; fp is the fingerprint as a signed long. A null text has no words: fp 0."""
    share_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "id long, fp long")


#: Members of a bucket that are compared directly where they are of different groups; larger buckets are divided first.
LARGE = 64
LEVELS = 3
#: Members of mixed buckets beyond which further rounds of stars are tried before all that are left are compared.
MANY = 1 << 14


def _joined(labels: DataFrame | None, more: DataFrame) -> DataFrame:
    """(node, root) of labels, whose roots are labelled by more in turn."""
    if labels is None:
        return more
    step = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return cut(labels.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(more))


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows whose root is labelled anew."""
    step = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
    rest = [c for c in rows.columns if c != "root"]
    return rows.join(step, "root", "left").select(*rest, F.coalesce("top", "root").alias("root"))


Near = Callable[[DataFrame, DataFrame], DataFrame]


def bucket_groups(points: DataFrame, divide: Callable[[DataFrame, int], DataFrame], near: Near, levels: int, large: int = LARGE, stars: int = 1, tag: Callable[[], DataFrame] | None = None, meets: Callable[[Column, Column], Column] | None = None) -> DataFrame | None:
    """(node, root): groups of points (x, root) whose roots are linked; None if there are no links.

    divide(rows, level) adds k, the buckets of that level, to rows (x, root, and what divide itself adds); near(pairs,
    ends) keeps those of pairs (a, ra, b), roots ra of a, that are links, given the present roots (b, rb) of all. Links
    are those of members of one bucket with different roots, and roots are the smallest of their group. In each bucket
    the members are linked to the one that meets most others, then, stars - 1 times and on while it pays, those that are
    not of its largest group to another member of that; and those that are then still of other groups are compared with
    all members. Buckets of over large members are divided by the next level first, as long as there is one. With tag()
    (x, s), that comparison is of s, within the join, and only pairs whose s meet leave it.
    """
    own = points.select(F.col("x").alias("b"), "root")
    labels, rows, cross = None, points, None

    def settle(pairs: DataFrame, met: DataFrame | None) -> DataFrame | None:
        """Add the links among pairs to labels; met with its roots as they are then."""
        nonlocal labels
        ends = (own if labels is None else _named(own, labels)).withColumnRenamed("root", "rb")
        found = connected_components(near(pairs, ends).join(ends, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        if found.isEmpty():
            return met
        labels = _joined(labels, found)
        return None if met is None else _named(met, found)

    mixed = lambda df: df.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("k", "n")
    for level in range(levels + 1):
        if level == levels or rows is None:
            if cross is not None:
                settle(cross, None)
            break
        rows = divide(rows, level)
        met = cut(rows.join(mixed(rows), "k"))
        # the text of which others are copies meets more of them than any copy does
        seen = met.groupBy("x").agg(F.sum("n").alias("seen_by"))
        order = F.shiftleft("seen_by", 20).bitwiseOR(F.xxhash64("x").bitwiseAND(F.lit((1 << 20) - 1)))
        pivot = met.select("k", "x").join(seen, "x").groupBy("k").agg(F.max_by("x", order).alias("p"))
        met = met.drop("n")
        star = met.join(pivot, "k").where("x <> p").select(F.col("x").alias("a"), F.col("root").alias("ra"), F.col("p").alias("b"))
        met = settle(star if cross is None else cross.unionByName(star), met)
        before, i = None, 0
        while stars > 1:
            met, i = cut(met.join(mixed(met), "k", "left_semi")), i + 1
            n_met = met.count()
            if not n_met:
                break
            # past the given rounds, more of them as long as they pay: comparing all that are left costs their square
            if i >= stars and (n_met < MANY or n_met > 0.8 * before):
                break
            before = n_met
            groups = met.groupBy("k", "root").agg(F.count("*").alias("n"), F.max_by("x", F.xxhash64("x", F.lit(i))).alias("x"))
            main = groups.groupBy("k").agg(F.max_by("x", "n").alias("p"))
            met = settle(met.join(main, "k").where("x <> p").select(F.col("x").alias("a"), F.col("root").alias("ra"), F.col("p").alias("b")), met)
        # of two members of different groups one at least is not of the bucket's largest: those are held against all
        sizes = met.groupBy("k", "root").agg(F.count("*").alias("m"))
        largest = sizes.groupBy("k").agg(F.max_by("root", F.struct("m", "root")).alias("top"), F.sum("m").alias("n"), F.count("*").alias("r")).where("r > 1").select("k", "top", "n")
        left = met.join(largest, "k").select("x", "root", "k", "n", (F.col("root") == F.col("top")).alias("main"), *[c for c in met.columns if c not in ("x", "root", "k", "n")])
        left = cut(left if tag is None else left.join(tag(), "x"))
        last = level + 1 == levels
        small = left if last else left.where(F.col("n") <= large)
        also = [] if tag is None else ["s"]
        x = small.where("not main").select("k", F.col("x").alias("a"), F.col("root").alias("ra"), *also)
        y = small.select("k", F.col("x").alias("b"), F.col("root").alias("rb2"), "main", *[F.col(c).alias("s2") for c in also])
        n_large = 0 if last else left.where(F.col("n") > large).count()
        apart = (F.col("ra") != F.col("rb2")) & (F.col("main") | (F.col("a") < F.col("b")))
        both = x.join(y, "k").where(apart if meets is None else apart & meets(F.col("s"), F.col("s2")))
        cross = both.select("a", "ra", "b") if n_large or not left.isEmpty() else None
        rows = left.where(F.col("n") > large).drop("k", "n", "main").distinct() if n_large else None
    return labels


def fingerprint_groups(points: DataFrame, radius: int = 4, large: int = LARGE) -> DataFrame:
    """(fp, root): the smallest fingerprint that is reachable over links within the radius, for distinct ones (column fp) that have a link."""

    def divide(rows: DataFrame, level: int) -> DataFrame:
        seen = F.col("seen") if level else F.lit(0).cast("long")
        shown = [seen.bitwiseOR(F.lit(m).cast("long")) for m in covering_masks(radius, 11 + level)]
        keys = [F.struct(F.xxhash64(m, F.col("x").bitwiseAND(m)).alias("k"), m.alias("seen")) for m in shown]
        return rows.select("x", "root", F.explode(F.array(*keys)).alias("t")).select("x", "root", "t.k", "t.seen")

    def near(pairs: DataFrame, _: DataFrame) -> DataFrame:
        return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()

    # rows are exploded, which Spark sizes as if they weren't
    with measured(points.sparkSession):
        groups = bucket_groups(points.select(F.col("fp").alias("x"), F.col("fp").alias("root")), divide, near, LEVELS, large)
    return points.select("fp", F.col("fp").alias("root")).limit(0) if groups is None else groups.withColumnRenamed("node", "fp")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the smallest id reachable over links of at most radius
    differing bits. Null and word-free texts have fingerprint zero and are linked like any other; a null id is carried
    but never names a component unless all ids of the component are null. Ids are whole numbers. Repeated rows each come back. Other columns,
    whatever their names, are not read. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    # each row is about to make 31: many partitions, however small the table of fingerprints is
    points = cut(fps.groupBy("fp").agg(F.min("id").alias("least")).repartition(_partitions(docs)))
    roots = fingerprint_groups(points.select("fp"), radius)
    rooted = points.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies of the training corpus: similarity of five-word shingles, not bits of one fingerprint.
#
# A pair that shares 0.8 of its five-word shingles differs in some nine of 64 bits, beyond what covering tables can
# take. Such pairs meet in bands of MinHash values instead: over 0.9996 of those at 0.8 share one of BANDS bands of ROWS
# values. Of those that meet, pairs whose MinHash values agree too rarely are left out (one in 10^4 at 0.8), and the rest
# are held against each other's whole sets of shingles.

BANDS, ROWS = 20, 5
#: Longs of a signature, 16 MinHash values in each, four bits of each value; and how many of them have to agree.
SIGNATURE = BANDS * ROWS // 16
AGREE = 64
#: Ids of documents that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_IDS = 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _runs(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the distinct runs of so many words; the whole text if it has fewer."""
    size = min(size, len(codes))
    h = np.zeros(len(codes) - size + 1, np.uint64)
    for t in range(size):
        h = _mixed(h * _GOLD + codes[t : t + len(h)] + np.uint64(t))
    return np.unique(h)


_ODD, _ADD = (np.random.default_rng(17).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[1], [0]], np.uint64))


def _minima(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values of a set of hashes."""
    least = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for at in range(0, len(hashes), 1 << 9):
        least = np.minimum(least, (hashes[at : at + (1 << 9), None] * _ODD + _ADD).min(0))
    return least


def _bands(least: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of MinHash values."""
    key = np.arange(1, BANDS + 1).astype(np.uint64)
    for values in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * _GOLD + values)
    return key.view(np.int64).tolist()


def _signature(least: np.ndarray) -> list[int]:
    """Four mixed bits of each value, packed."""
    bits = (_mixed(least[: 16 * SIGNATURE]) & np.uint64(15)).reshape(SIGNATURE, 16) << (4 * np.arange(16)).astype(np.uint64)
    return np.bitwise_or.reduce(bits, axis=1).view(np.int64).tolist()


def _codes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, bands, sig) of every row with an id: the op's fingerprint, and the band keys and signature of its five-word shingles."""
    share_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, bands, sig = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                codes = _codes(text)
                least = _minima(_runs(codes, 5) if len(codes) else codes)
                fps.append(fingerprint(text))
                bands.append(_bands(least))
                sig.append(_signature(least))
            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64()), pa.array(bands, kinds), pa.array(sig, kinds)], names=["id", "fp", "bands", "sig"])

    kept = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "id long, fp long, bands array<long>, sig array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, h): 32-bit hashes of the distinct five-word shingles of the documents whose ids are in ids (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for text in batch.column(1):
                codes = _codes(text.as_py())
                sets.append(np.unique((_runs(codes, 5) >> np.uint64(32)).astype(np.uint32)).view(np.int32) if len(codes) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["node", "h"])

    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(ids) if few else ids, "node", "left_semi").select("node", "text").mapInArrow(run, "node long, h array<int>")


def _agreeing(x: Column, y: Column) -> Column:
    """How many of the packed four-bit values of two signatures are equal."""
    def of(i: int) -> Column:
        d = x[i].bitwiseXOR(y[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.lit(16) - F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    total = of(0)
    for i in range(1, SIGNATURE):
        total = total + of(i)
    return total


#: Times that a bucket's members are held against one member of its largest group before all of those left are compared.
STARS = 4


def copy_groups(nodes: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame | None:
    """(node, root): groups of nodes (node, root, bands, sig) whose roots are linked by near copies; None if there are none.

    Near copies share a band and have five-word shingles of at least the similarity (Jaccard), counted in docs, whose
    ids the nodes are. Texts are read once, for the shingles of all that share a band with one of another root.
    """
    bands, sigs = nodes.select(F.col("node").alias("x"), "bands"), nodes.select(F.col("node").alias("x"), F.col("sig").alias("s"))
    agree = lambda x, y: _agreeing(x, y) >= AGREE
    shared = lambda x, y: F.size(F.array_intersect(x, y))
    similar = lambda x, y: shared(x, y) * (1 + similarity) >= similarity * (F.size(x) + F.size(y)) - 1e-9
    # sets of very different sizes can't be similar
    sized = lambda x, y: (F.size(x) >= similarity * F.size(y) - 1e-9) & (F.size(y) >= similarity * F.size(x) - 1e-9)
    sets: list[DataFrame] = []

    def divide(rows: DataFrame, _: int) -> DataFrame:
        return rows.join(bands, "x").select("x", "root", F.explode("bands").alias("k"))

    def near(pairs: DataFrame, ends: DataFrame) -> DataFrame:
        pairs = pairs.distinct()
        if not sets:  # the first pairs name every member of a bucket that has several roots
            pairs = cut(pairs)
            sets.append(cut(shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), id_col, text_col)))
        pairs = pairs.join(ends, "b").where("ra <> rb").select("a", "ra", "b")
        alike = pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b").where(agree(F.col("sa"), F.col("sb"))).select("a", "ra", "b")
        met = alike.join(sets[0].toDF("a", "ha"), "a").join(sets[0].toDF("b", "hb"), "b")
        return met.where(sized(F.col("ha"), F.col("hb")) & similar(F.col("ha"), F.col("hb"))).select("a", "ra", "b").distinct()

    def tag() -> DataFrame:
        return sigs.join(sets[0].toDF("x", "h"), "x").select("x", F.struct("s", "h").alias("s"))

    with measured(docs.sparkSession):
        return bucket_groups(nodes.select(F.col("node").alias("x"), "root"), divide, near, 1, stars=STARS, tag=tag, meets=lambda x, y: sized(x["h"], y["h"]) & agree(x["s"], y["s"]) & similar(x["h"], y["h"]))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay: of each group of near copies the row with the smallest id, with docs' own columns.

    Near copies: rows whose fingerprints are within the radius, or whose five-word shingles are as similar as asked.
    Null, empty and word-free texts are copies of each other. Rows that repeat one id count as one document: the first
    by text stays. Rows with a null id stay, one of each text. Ids are whole numbers. An empty table gives an empty
    result; columns may have any names. A whole text is shuffled once, to meet the decision on its id; a second time
    if over BROADCAST_IDS documents have to be held against others.
    """
    sk = cut(sketches(docs, id_col, text_col))
    kinds = cut(sk.groupBy("fp", "bands", "sig").agg(F.min("id").alias("node")).repartition(_partitions(docs)))
    fps = kinds.groupBy("fp").agg(F.min("node").alias("least"))
    roots = fingerprint_groups(fps.select("fp"), radius)
    rooted = fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("r"), "least")
    named = rooted.join(rooted.groupBy("r").agg(F.min("least").alias("root")), "r").select("fp", "root")
    nodes = cut(kinds.join(named, "fp").select("node", "root", "bands", "sig").repartition(_partitions(docs)))
    groups = copy_groups(nodes, docs, id_col, text_col, similarity)
    ends = nodes.select("node", "root") if groups is None else _named(nodes.select("node", "root"), groups)
    own, number = free_names(docs, 2)
    stay = ends.where("node = root").select(F.col("node").alias(own)).distinct()
    key = F.col(id_col).cast("long")
    kept = docs.join(stay, key == F.col(own), "left_semi")
    first = lambda by: F.row_number().over(W.partitionBy(by).orderBy(F.col(text_col)))
    blank = docs.where(F.col(id_col).isNull())
    return kept.withColumn(number, first(key)).unionByName(blank.withColumn(number, first(F.col(text_col)))).where(F.col(number) == 1).drop(number)

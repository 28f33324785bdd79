"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed to cells of source, language and topic. Raking scales the cells' sampling probabilities, margin after
margin, until the expected tokens of every source, language and topic meet their targets; a probability never exceeds
one, and what a full cell cannot give is asked of the others of its margin in the next round. Rounds end when a round
leaves the shares of all categories where they were, which also ends them where caps keep targets out of reach. Documents
are then drawn by their cell's probability and a hash of their id.

Topics are learned: spherical k-means over hashed terms, weighted by their rarity, of all documents; every document is
then given the topic whose centre is nearest to the terms of its whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.session import cut, free_names, share_code

MARGINS = ("source", "lang", "topic")
#: Cells up to which raking runs on the driver in numpy; beyond, the same steps run as Spark jobs.
DRIVER_CELLS = 100_000
ROUNDS, TOLERANCE = 100, 1e-5
#: Topics, hashed terms, and rounds in which centres move at most.
TOPICS, TERM_BITS, TOPIC_ROUNDS = 8, 10, 12
#: Weights of terms are summed as whole numbers of this size, so that sums do not depend on the order of tasks.
_UNIT = 1 << 20
#: The category of rows whose value is null, and the topic of texts without words.
NONE = "(none)"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def terms_of(text: str | None) -> tuple[int, np.ndarray]:
    """Words of a whole text, by white space, and how often each hashed term occurs in it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return len(words), np.bincount(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & ((1 << TERM_BITS) - 1), minlength=1 << TERM_BITS)


def _norm(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) if len(x) else x


class Topics:
    """Centres of topics, for texts as damped counts of their terms times the terms' rarity."""

    def __init__(self, rarity: np.ndarray, centre: np.ndarray):
        self.rarity, self.centre = rarity.astype(np.float32), centre.astype(np.float32)

    def unit(self, counts: np.ndarray) -> np.ndarray:
        return _norm(np.log1p(counts).astype(np.float32) * self.rarity)

    def of(self, counts: np.ndarray) -> np.ndarray:
        return (self.unit(counts) @ self.centre.T).argmax(1) if len(self.centre) else np.zeros(len(counts), np.int64)


def _packed(parts: list[np.ndarray], kind: type) -> pa.BinaryArray:
    """Numbers of each text as bytes: Spark hands those on whole, an array number by number."""
    flat = np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def _unpacked(column: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each text has, and those of all."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(ends) // np.dtype(kind).itemsize, np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind)


def _weights(terms: pa.BinaryArray, logs: pa.BinaryArray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Topics.unit of texts that are given by their terms; and the places in it that are not zero."""
    n, at = _unpacked(terms, np.int16)
    rows = np.repeat(np.arange(len(n)), n)
    x = np.zeros((len(n), len(rarity)), np.float32)
    x[rows, at] = _unpacked(logs, np.float32)[1] * rarity[at]
    return _norm(x), rows, at


def _summed(counts: DataFrame, slots: int, add) -> np.ndarray:
    """Whole numbers by slot, summed over all texts: add(terms, logs) gives those of a batch; a task sends one row a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += add(batch.column(1), batch.column(2))
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(total[have])], names=["i", "v"])

    out = np.zeros(slots, np.int64)
    for r in counts.mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _picked(counts: DataFrame, topics: Topics, turn: int) -> np.ndarray | None:
    """Topics.unit of one text of all, drawn by a hash with a chance in proportion to its distance from the nearest centre; None if all lie on centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _weights(batch.column(1), batch.column(2), topics.rarity)[0]
            # texts of common terms alone have no weight, and are far from nothing
            far = np.where(x.any(1), np.clip(1 - (x @ topics.centre.T).max(1), 0, None), 0).astype(float) if len(topics.centre) else np.ones(len(x))
            draw = batch.column(0).to_numpy().view(np.uint64) ^ np.uint64(turn)
            for _ in range(2):
                draw = (draw ^ (draw >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            wait = -np.log((draw >> np.uint64(11)).astype(float) / 2**53 + 2**-54) / np.maximum(far, 1e-12)
            first = int(np.lexsort((batch.column(0).to_numpy(), np.where(far > 1e-6, wait, np.inf)))[0])
            if far[first] > 1e-6:
                yield pa.RecordBatch.from_arrays([pa.array([wait[first]]), *(batch.column(i).slice(first, 1) for i in range(3))], names=["w", "d", "t", "l"])

    best = counts.mapInArrow(run, "w double, d long, t binary, l binary").agg(F.min(F.struct("w", "d", "t", "l")).alias("b")).first()["b"]
    return None if best is None else _weights(pa.array([bytes(best["t"])], pa.binary()), pa.array([bytes(best["l"])], pa.binary()), topics.rarity)[0]


def learn_topics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topics: int = TOPICS, rounds: int = TOPIC_ROUNDS) -> Topics:
    """Topics of all documents. Term counts of whole texts are written once; each centre's first place, and each round, is one pass over them whose sums alone reach the driver."""
    share_code(docs.sparkSession)
    width = 1 << TERM_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(t.as_py()) for t in batch.column(1)]
            kept = np.flatnonzero([n > 0 for n, _ in found])
            have = [np.flatnonzero(found[i][1]) for i in kept]
            logs = [np.log1p(found[i][1][h]) for i, h in zip(kept, have, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), _packed(have, np.int16), _packed(logs, np.float32)], names=["d", "t", "l"])

    draw = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col)), F.lit("topic"))
    counts = cut(docs.select(draw.alias("d"), F.col(text_col).alias("t")).mapInArrow(run, "d long, t binary, l binary"))
    there = _summed(counts, width + 1, lambda terms, _: np.append(np.bincount(_unpacked(terms, np.int16)[1], minlength=width), len(terms)))
    made = Topics(np.log((1 + there[width]) / (1 + there[:width])), np.zeros((0, width)))
    for turn in range(topics):
        found = _picked(counts, made, turn)
        if found is None:
            break
        made = Topics(made.rarity, np.concatenate([made.centre, found]))
    before = None
    for _ in range(rounds if len(made.centre) else 0):

        def add(terms: pa.BinaryArray, logs: pa.BinaryArray, made=made) -> np.ndarray:
            x, rows, at = _weights(terms, logs, made.rarity)
            near = (x @ made.centre.T).argmax(1)
            # whole numbers, exact in doubles
            return np.bincount(near[rows] * width + at, np.rint(x[rows, at] * _UNIT), len(made.centre) * width).astype(np.int64)

        sums = _summed(counts, len(made.centre) * width, add)
        if before is not None and (sums == before).all():
            break
        before, sums = sums, sums.reshape(-1, width)
        made = Topics(made.rarity, np.where(sums.any(1)[:, None], _norm(sums.astype(float)), made.centre))
    return made


def told(topics: Topics | None) -> Column:
    """A function of a text column: struct(n, topic) of a whole text; no topic if topics are not asked for."""

    def run(texts: pa.Array) -> pa.Array:
        n, names = [], []
        for i in range(0, len(texts), 256):
            found = [terms_of(t.as_py()) for t in texts[i : i + 256]]
            n += [x for x, _ in found]
            best = [None] * len(found) if topics is None else topics.of(np.array([c for _, c in found])).tolist()
            names += [f"topic{k}" if k is not None and x else None for k, (x, _) in zip(best, found, strict=True)]
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(names, pa.string())], ["n", "topic"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "n long, topic string")


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, keep: bool = False) -> tuple[DataFrame, list[str]]:
    """Rows with the names of source, lang, topic, n_tokens and u columns; keep: beside docs' own columns, else beside id.

    u in [0, 1) is drawn from the id, or from the text if that is null.
    """
    share_code(docs.sparkSession)
    topics = learn_topics(docs, id_col, text_col) if topic is None else None
    names = free_names(docs, 6) if keep else [*MARGINS, "n_tokens", "u", "_told"]
    name = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    draw = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col)), F.lit("mix"))
    kinds = [F.col(source_col), F.col(lang_col), F.col(f"{names[5]}.topic") if topic is None else topic]
    made = [name(c).alias(n) for c, n in zip(kinds, names, strict=False)] + [F.col(f"{names[5]}.n").alias(names[3]), (F.pmod(draw, F.lit(1 << 40)) / F.lit(float(1 << 40))).alias(names[4])]
    wide = docs.withColumn(names[5], told(topics)(F.col(text_col)))
    return wide.select(*(docs.columns if keep else [F.col(id_col).alias("id")]), *made), names[:5]


def tempered(totals: dict[str, float], power: float) -> dict[str, float]:
    """Target shares in proportion to a power of the tokens: below 1 lifts small categories."""
    raised = {k: v**power for k, v in totals.items() if v > 0}
    whole = sum(raised.values()) or 1.0
    return {k: v / whole for k, v in raised.items()}


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rate: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Probabilities of cells: codes number each cell's category in every margin, targets are shares by number."""
    p = np.full(len(tokens), rate)
    budget = rate * tokens.sum()
    if budget <= 0:
        return p
    reached = lambda: [np.bincount(c, tokens * p, len(t)) / budget for c, t in zip(codes, targets, strict=True)]
    before = reached()
    for _ in range(rounds):
        for code, share in zip(codes, targets, strict=True):
            have = np.bincount(code, tokens * p, len(share))
            factor = np.divide(share * budget, have, out=np.ones(len(share)), where=have > 0)
            p = np.minimum(1.0, p * factor[code])
        now = reached()
        if max(float(np.abs(x - y).max(initial=0.0)) for x, y in zip(now, before, strict=True)) < tolerance:
            break
        before = now
    return p


def _rake_on_spark(spark: SparkSession, cells: DataFrame, targets: dict[str, DataFrame], rate: float, rounds: int, tolerance: float) -> DataFrame:
    """The steps of rake over a table of cells of any size, with the same stop."""
    budget = rate * (cells.agg(F.sum("t")).first()[0] or 0)
    cur = cut(cells.withColumn("p", F.lit(float(rate))))
    if budget <= 0:
        return cur

    def reached(df: DataFrame) -> DataFrame:
        each = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("k")) for m in MARGINS])).alias("x"), (F.col("t") * F.col("p") / budget).alias("s"))
        return cut(each.groupBy("x.m", "x.k").agg(F.sum("s").alias("s")))

    before = reached(cur)
    for _ in range(rounds):
        for m in MARGINS:
            have = cur.groupBy(m).agg(F.sum(F.col("t") * F.col("p")).alias("have"))
            factor = have.join(targets[m], m, "left").select(m, F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0)) * budget / F.col("have")).otherwise(F.lit(1.0)).alias("f"))
            cur = cur.join(factor, m).select(*MARGINS, "t", F.least(F.lit(1.0), F.col("p") * F.col("f")).alias("p"))
        cur = cut(cur)
        now = reached(cur)
        moved = now.join(before.withColumnRenamed("s", "s0"), ["m", "k"]).agg(F.max(F.abs(F.col("s") - F.col("s0")))).first()[0]
        if (moved or 0.0) < tolerance:
            break
        before = now
    return cur


def cell_probabilities(rows: DataFrame, rate: float = 0.4, power: float = 0.8, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE, driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, bool]:
    """(source, lang, topic, p) for every cell of described rows, and whether the table is small enough to broadcast.

    targets: shares by margin and category; a margin that is not given is tempered by power. A category without a
    target gets none; a target without tokens is left out and the rest of its margin is scaled to one.
    """
    spark = rows.sparkSession
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("t")))
    small = cells.limit(driver_cells + 1).count() <= driver_cells
    shares: dict[str, DataFrame] = {}
    if not small:
        for m in MARGINS:
            sums = cells.groupBy(m).agg(F.sum("t").alias("s"))
            if targets and m in targets:
                given = spark.createDataFrame(list(targets[m].items()), f"{m} string, g double")
                sums = sums.join(given, m).select(m, F.when(F.col("s") > 0, F.col("g")).otherwise(F.lit(0.0)).alias("s"))
            else:
                sums = sums.select(m, F.pow("s", F.lit(power)).alias("s"))
            whole = sums.agg(F.sum("s")).first()[0] or 1.0
            shares[m] = cut(sums.select(m, (F.col("s") / whole).alias("share")))
        return _rake_on_spark(spark, cells, shares, rate, rounds, tolerance).select(*MARGINS, "p"), False
    got = cells.orderBy(*MARGINS).collect()
    tokens = np.array([r["t"] for r in got], dtype=float)
    codes, wanted = [], []
    for m in MARGINS:
        names = sorted({r[m] for r in got})
        number = {k: i for i, k in enumerate(names)}
        code = np.array([number[r[m]] for r in got], dtype=np.int64)
        totals = dict(zip(names, np.bincount(code, tokens, len(names)).tolist(), strict=True))
        share = {k: v for k, v in targets[m].items() if totals.get(k, 0) > 0} if targets and m in targets else tempered(totals, power)
        whole = sum(share.values()) or 1.0
        codes.append(code)
        wanted.append(np.array([share.get(k, 0.0) / whole for k in names]))
    p = rake(tokens, codes, wanted, rate, rounds, tolerance) if len(got) else tokens
    made = [(*(r[m] for m in MARGINS), float(x)) for r, x in zip(got, p, strict=True)]
    return spark.createDataFrame(made, "source string, lang string, topic string, p double"), True


def mixing_plan(docs: DataFrame, rate: float = 0.4, power: float = 0.8, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, driver_cells: int = DRIVER_CELLS, **columns) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, prob, sampled): one row per row of docs.

    prob: the probability of the row's cell; weight: prob / rate, the raked token weight; sampled: drawn by prob. Null
    sources, languages and topics are categories of their own, named (none); so is the topic of texts without words.
    Empty and null texts have no tokens and take their cell's probability. Repeated rows share one draw; rows with a
    null id are drawn by their text. An empty table gives an empty result. Other columns are not read. rate is the share
    of all tokens to draw; topic: a column that names topics, which are learned where it is not given.
    """
    rows = cut(described(docs, topic=topic, **columns)[0])
    cells, small = cell_probabilities(rows, rate, power, targets, driver_cells=driver_cells)
    met = rows.join(F.broadcast(cells) if small else cells, list(MARGINS))
    return met.select(F.col("id").alias("doc_id"), *MARGINS, "n_tokens", (F.col("p") / rate).alias("weight"), F.col("p").alias("prob"), (F.col("u") < F.col("p")).alias("sampled"))


def reached_margins(plan: DataFrame, rate: float = 0.4, power: float = 0.8, targets: dict[str, dict[str, float]] | None = None, tolerance: float = 0.005) -> DataFrame:
    """(margin, category, target, reached, missed): the shares of the expected tokens of a mixing_plan and those asked for, one row a category that has tokens."""
    each = plan.select(F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("category")) for m in MARGINS])).alias("x"), "n_tokens", (F.col("n_tokens") * F.col("prob")).alias("e"))
    sums = each.groupBy("x.margin", "x.category").agg(F.sum("n_tokens").cast("double").alias("t"), F.sum("e").alias("e")).where("t > 0")
    asked = F.pow("t", F.lit(power))
    if targets:
        given = plan.sparkSession.createDataFrame([(m, k, float(v)) for m, of in targets.items() for k, v in of.items()], "margin string, category string, g double")
        sums = sums.join(given, ["margin", "category"], "left")
        asked = F.when(F.col("margin").isin(list(targets)), F.coalesce("g", F.lit(0.0))).otherwise(asked)
    sums = sums.withColumn("a", asked)
    whole = sums.groupBy("margin").agg(F.sum("a").alias("wa"), F.sum("e").alias("we"), F.sum("t").alias("wt"))
    shares = sums.join(whole, "margin").select("margin", "category", (F.col("a") / F.col("wa")).alias("target"), (F.col("e") / (F.lit(rate) * F.col("wt"))).alias("reached"))
    return shares.withColumn("missed", F.abs(F.col("target") - F.col("reached")) > tolerance)


def mix(docs: DataFrame, rate: float = 0.4, power: float = 0.8, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, **columns) -> DataFrame:
    """The drawn rows of docs, with docs' own columns and sample_prob, which replaces a column of that name.

    Nulls, empty texts, repeated rows and empty tables as in mixing_plan; columns may have any other names.
    """
    wide, names = described(docs, topic=topic, keep=True, **columns)
    slim = wide.select(*[F.col(n).alias(m) for n, m in zip(names, (*MARGINS, "n_tokens"), strict=False)])
    cells, small = cell_probabilities(slim, rate, power, targets)
    (p,) = set(free_names(wide, 6)[-1:])
    probs = cells.toDF(*names[:3], p)
    met = wide.join(F.broadcast(probs) if small else probs, names[:3]).where(F.col(names[4]) < F.col(p))
    return met.select(*[c for c in docs.columns if c != "sample_prob"], F.col(p).alias("sample_prob"))

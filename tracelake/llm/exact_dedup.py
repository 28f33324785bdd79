"""Exact duplicates by a 128-bit hash of the whole text, with the bytes compared inside groups; DataFrame functions only.

Every text is hashed where it is read, and narrow rows (id, hash) are written once. Groups are counted over them, combined
before the shuffle, so that a hot group costs one row a task. Only texts whose hash repeats are compared: they are grouped
by hash and text, again combined before the shuffle, so that each task sends a distinct text once however many copies it
has. Where the texts of one hash differ, the hash collides and the text itself tells its rows apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.session import cut, free_names

#: Rows of groups (16 bytes of hash and some numbers each) that are broadcast; beyond it the same joins are shuffled.
BROADCAST_GROUPS = 1 << 18


def content_hash(text: Column) -> Column:
    """128 bits of the bytes of a text."""
    return F.unhex(F.md5(text))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast where it has few rows; rows is their exact number."""
    return F.broadcast(df) if rows <= BROADCAST_GROUPS else df


def _collisions(docs: DataFrame, text: Column, rows: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame | None:
    """The hashes that several different texts share, if any: of texts whose hash repeats, the bytes are compared."""
    repeated = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    met = docs.select(hashed(text).alias("h"), text.alias("t")).join(_bounded(repeated, repeated.count()), "h", "left_semi")
    texts = met.groupBy("h", "t").agg(F.lit(1).alias("one"))
    collided = cut(texts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    n = collided.count()
    return _bounded(collided, n) if n else None


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "first",
    normalise: Callable[[Column], Column] | None = None,
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of docs.

    keep: first or last, the smallest or the largest id of equal texts stays. normalise: a function of the text column
    before texts are compared; none compares them as they are. A null text is an empty one. Ids order as their type does;
    a null id stays only if no row of its text has an id. Of rows that repeat an id and a text one says kept. An empty
    table gives an empty result; columns beside the two are not read. hashed may be any function of a text, since
    collisions are told apart.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    text = normalise(text) if normalise else text
    return _verdicts(docs, F.col(f"`{id_col}`"), text, keep, hashed).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _verdicts(docs: DataFrame, key: Column, text: Column, keep: str, hashed: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha, h, t) of every row; t is null, but where a hash stands for several texts."""
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    own = docs.select(key.alias("doc_id"), text.alias("text")).select("doc_id", "text", hashed(F.col("text")).alias("h"), F.unhex(F.sha2("text", 256)).alias("sha"))
    # written before rows are numbered: a number that a lost task gives anew may differ
    rows = cut(own.select("doc_id", "h", "sha"))
    collided = _collisions(docs, text, rows, hashed)
    if collided is None:
        told = rows.withColumn("t", F.lit(None).cast("string"))
    else:
        marked = own.join(collided.withColumn("several", F.lit(True)), "h", "left")
        told = cut(marked.select("doc_id", "h", "sha", F.when(F.col("several"), F.col("text")).alias("t")))
    told = told.withColumn("row", F.monotonically_increasing_id())
    least = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row"))
    most = F.max(F.struct(F.col("doc_id").isNotNull().alias("x"), "doc_id", "row"))
    groups = told.groupBy("h", "t").agg((least if keep == "first" else most).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = cut(groups.select(F.col("h").alias("gh"), F.col("t").alias("gt"), F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n"))
    met = told.join(_bounded(groups, groups.count()), (F.col("h") == F.col("gh")) & F.col("t").eqNullSafe(F.col("gt")), "left")
    alone = F.col("n").isNull()
    return met.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "sha",
        "h",
        "t",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "first", normalise: Callable[[Column], Column] | None = None, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of docs that stay, with docs' own columns: of equal texts one row, as exact_groups tells.

    Rows that repeat the id that stays are brought down to one, whatever their other columns hold. Cases as in
    exact_groups; columns may have any names. Ids and hashes of the rows that go are matched, not texts.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    text = normalise(text) if normalise else text
    told = _verdicts(docs, F.col(f"`{id_col}`"), text, keep, hashed)
    key, mark, many = free_names(docs, 3)
    # one row a set of rows with equal id and text of which some go: all of them, or all but one
    sets = told.groupBy("doc_id", "h", "sha").agg(F.count_if("kept").alias("stay"), F.count(F.lit(1)).alias("n")).where("stay < n")
    sets = cut(sets.select(F.struct("doc_id", "h", "sha").alias(key), F.col("stay").alias(mark)))
    if not sets.count():
        return docs
    own = docs.withColumn(many, F.struct(F.col(f"`{id_col}`").alias("doc_id"), hashed(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("sha")))
    out = own.join(_bounded(sets, sets.count()), F.col(many).eqNullSafe(F.col(key)), "left")
    single = out.where(F.col(mark).isNull())
    repeats = out.where(F.col(mark) > 0)
    if repeats.limit(1).count():
        single = single.unionByName(repeats.dropDuplicates([many]))
    return single.select(*[F.col(f"`{c}`") for c in docs.columns])

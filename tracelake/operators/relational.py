"""Relational helpers that Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.session import cut


def asof_join(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, take: Sequence[str], strict: bool = False, bucket_seconds: int | None = None) -> DataFrame:
    """left with the columns take of the last right row of the same key at or before (strict: before) its time.

    Left rows without one keep nulls; rows with a null key or time match nothing. Both sides are tagged, put in one
    order a key and filled forward, so the cost is one shuffle. With bucket_seconds a key's rows are split by time and
    the last right row of every bucket is carried over by a second, small window: a key of any size is then shared out.
    """
    row = F.struct(*[F.col(c).alias(c) for c in take])
    lhs = left.select(F.col(on).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1 if strict is False else 0).alias("_tag"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_r"), F.struct("*").alias("_l"))
    # at one time, right rows come first (tag 0) unless the bound is strict
    rhs = right.where(F.col(on).isNotNull() & F.col(right_ts).isNotNull()).select(F.col(on).alias("_k"), F.col(right_ts).alias("_t"), F.lit(0 if strict is False else 1).alias("_tag"), row.alias("_r"), F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("_l"))
    both = lhs.unionByName(rhs)
    if bucket_seconds is None:
        filled = both.withColumn("_r", F.last("_r", True).over(W.partitionBy("_k").orderBy("_t", "_tag").rowsBetween(W.unboundedPreceding, 0)))
    else:
        both = both.withColumn("_b", F.floor(F.unix_seconds(F.col("_t").cast("timestamp")) / bucket_seconds))
        filled = both.withColumn("_in", F.last("_r", True).over(W.partitionBy("_k", "_b").orderBy("_t", "_tag").rowsBetween(W.unboundedPreceding, 0)))
        ends = both.where(F.col("_k").isNotNull()).groupBy("_k", "_b").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_tag"))).alias("_end"))
        carried = ends.select("_k", "_b", F.last("_end", True).over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
        filled = filled.join(carried, ["_k", "_b"], "left").withColumn("_r", F.coalesce("_in", "_before"))
    known = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    return filled.where(F.col("_l").isNotNull()).select("_l.*", *[F.when(known, F.col(f"_r.{c}")).alias(c) for c in take])


def range_join(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str, width: float, on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """points with every range that holds them (lo <= point < hi) and, if given, has the same on columns.

    Ranges are spread over bins of the given width, so the join is an equi-join on the bin, never a cross join. Both
    sides' other columns must differ; a range longer than many bins costs a row a bin.
    """
    spread = ranges.where(F.col(lo) < F.col(hi)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - F.lit(1e-9)) / width)))).withColumnsRenamed({c: f"_r_{c}" for c in on})
    binned = points.withColumn("_bin", F.floor(F.col(point) / width)).withColumnRenamed("_bin", "_pbin")
    cond = (F.col("_pbin") == F.col("_bin")) & (F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))
    for c in on:
        cond &= binned[c] == F.col(f"_r_{c}")
    return binned.join(spread, cond, how).drop("_bin", "_pbin", *[f"_r_{c}" for c in on])


def newest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The whole row with the greatest version of every key; combined on the map side."""
    return df.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*version)).alias("_row")).select("_row.*")


def due(seeds: DataFrame, log: DataFrame, key: str, ts: str, since: Column) -> DataFrame:
    """Seeds with no log row at or after since."""
    return seeds.join(log.where(F.col(ts) >= since).select(key).distinct(), key, "left_anti")


def merge_new(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target and those source rows whose key it lacks."""
    return target.unionByName(source.join(target.select(*keys).distinct(), list(keys), "left_anti"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def incremental_merge(target: DataFrame, source: DataFrame, keys: Sequence[str], ts: str, overlap: Column) -> DataFrame:
    """target after a pull of the source rows at or after its last time less the overlap; keys gone from source go."""
    mark = target.agg(F.max(ts).alias("_mark"))
    fresh = source.join(F.broadcast(mark), F.col("_mark").isNull() | (F.col(ts) >= F.col("_mark") - overlap)).drop("_mark")  # one row
    tagged = target.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    live = source.select(*keys).distinct()
    return newest_per_key(tagged, keys, [ts, "_new"]).drop("_new").join(live, list(keys), "left_semi")


def due_tables(sources: DataFrame, log: DataFrame, table: str, status: str, finished: str, now: Column, n: int, ok_seconds: int = 300, error_seconds: int = 30) -> DataFrame:
    """The n most overdue tables: ok_seconds after success, error_seconds after an error, at once if never pulled."""
    last = log.groupBy(table).agg(F.max_by(status, finished).alias("last_status"), F.max(finished).alias("last_finished"))
    wait = F.when(F.col("last_status") == "ok", ok_seconds).otherwise(error_seconds)
    at = F.unix_seconds(F.col("last_finished").cast("timestamp")) + wait
    overdue = F.unix_seconds(now) - at
    found = sources.join(last, table, "left").withColumn("overdue", overdue).where(F.col("overdue").isNull() | (F.col("overdue") >= 0))
    return found.orderBy(F.col("overdue").desc_nulls_first(), table).limit(n)


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """df with a running total of each of sums over the rows of its group in order, the row itself included; groups may be of any size.

    Two passes: rows are dealt by ranges of group and order, so that a large group lies in many tasks, and each range
    sums up what it has of a group; then every row adds up within its range, beginning with what the ranges before it
    have of the group. A range has at most one group that began before it, so those beginnings are few and are broadcast.
    Rows of equal order follow each other as they come: make the order unique where that matters. Null values add
    nothing; null keys are a group, null orders come first.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value, total, part, row = (f"_{x}" for x in ("value", "total", "part", "row"))
    by = [F.col(f"`{c}`").asc_nulls_first() for c in (*keys, *order)]
    df = df.withColumns({f"{value}{i}": c for i, c in enumerate(sums.values())}).repartitionByRange(n, *by)
    # written down: a range that is dealt anew may have other bounds
    dealt = cut(df.sortWithinPartitions(*by).withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id()}))
    k = [F.col(f"`{c}`") for c in keys]
    own = dealt.groupBy(part, *k).agg(*[F.sum(f"{value}{i}").alias(f"{total}{i}") for i in range(len(sums))])
    before = W.partitionBy(*k).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    begins = own.withColumns({f"{total}{i}": F.coalesce(F.sum(f"{total}{i}").over(before), F.lit(0)) for i in range(len(sums))} | {row: F.row_number().over(W.partitionBy(*k).orderBy(part))})
    begins = begins.where(F.col(row) > 1).select(F.col(part).alias("_p"), *[c.alias(f"_k{i}") for i, c in enumerate(k)], *[f"{total}{i}" for i in range(len(sums))])
    same = F.col(part) == F.col("_p")
    for i, c in enumerate(k):
        same = same & c.eqNullSafe(F.col(f"_k{i}"))
    local = W.partitionBy(part, *k).orderBy(row).rowsBetween(W.unboundedPreceding, 0)
    met = dealt.join(F.broadcast(begins), same, "left")  # at most one row a range
    for i, name in enumerate(sums):
        met = met.withColumn(name, F.coalesce(F.sum(f"{value}{i}").over(local), F.lit(0)) + F.coalesce(f"{total}{i}", F.lit(0)))
    return met.drop(part, row, "_p", *[f"_k{i}" for i in range(len(k))], *[f"{x}{i}" for x in (value, total) for i in range(len(sums))])


def prefix_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, max_rows: int, max_bytes: int) -> DataFrame:
    """Per group the longest prefix of rows within a row and a byte budget; no row is skipped to fit a later one.

    Adds returned, total, truncated and reason (rows, bytes or null) to every row that is returned. A group whose first
    row alone is over the budget returns none: one row stands for it, with its keys, nulls for the other columns, and
    the reason oversized_row (rows, if no row may be returned at all). Groups may be of any size: their rows are added up
    in ranges, and what comes after is sums by group.
    """
    columns = df.columns
    df = cut(running_totals(df, keys, order, {"_n": F.lit(1), "_bytes": F.octet_length(text).cast("long")}))
    fits = (F.col("_n") <= max_rows) & (F.col("_bytes") <= max_bytes)
    k = [F.col(f"`{c}`") for c in keys]
    # the sum never falls, so the rows that fit are a prefix, and the first that does not is over the bytes if its sum is
    found = df.groupBy(*k).agg(F.count("*").alias("total"), F.count_if(fits).alias("returned"), F.min(F.when(F.col("_bytes") > max_bytes, F.col("_n"))).alias("_over"))
    found = found.select(*[c.alias(f"_k{i}") for i, c in enumerate(k)], "total", "returned", "_over")
    same = F.lit(True)
    for i, c in enumerate(k):
        same = same & c.eqNullSafe(F.col(f"_k{i}"))
    none = F.col("returned") == 0
    df = df.where(fits | (F.col("_n") == 1)).join(found, same).where(fits | none)
    df = df.withColumns({c: F.when(~none, F.col(f"`{c}`")) for c in columns if c not in keys})
    over = F.coalesce(F.col("_over") == F.col("returned") + 1, F.lit(False))
    reason = F.when(F.col("returned") == F.col("total"), None).when(none & F.lit(max_rows > 0), "oversized_row").when((F.col("returned") >= max_rows) | ~over, "rows").otherwise("bytes")
    return df.withColumns({"truncated": F.col("returned") < F.col("total"), "reason": reason}).drop("_n", "_bytes", "_over", *[f"_k{i}" for i in range(len(k))])


def pack_batches(df: DataFrame, group: Sequence[str], key: str, size: Column, limit: int) -> DataFrame:
    """(group, key, size, batch): keys of a group in order, packed to batches of about limit; a key stays whole.

    Groups may be of any size: their keys are added up in ranges.
    """
    sums = df.groupBy(*group, key).agg(F.sum(size).alias("size"))
    run = running_totals(sums, group, [key], {"_until": F.col("size")})
    return run.withColumn("batch", F.floor((F.col("_until") - F.coalesce("size", F.lit(0))) / limit).cast("long")).drop("_until")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], starts: Column, name: str = "island") -> DataFrame:
    """df with the number of the island of each row: the running count of rows that start one."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_starts", starts).withColumn(name, F.sum(F.coalesce(F.col("_starts").cast("long"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_starts")


def lower_median(values: str) -> Column:
    """The lower middle of the sorted numbers of a group, counted by value, not listed."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{values}`)")


def with_total(df: DataFrame, key: str, aggs: Sequence[Column], total: str = "TOTAL") -> DataFrame:
    """Rows by key and one TOTAL row, in one pass."""
    g = df.rollup(key).agg(*aggs, F.grouping_id().alias("_g"))
    return g.withColumn(key, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(key).cast("string"))).drop("_g")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, copies counted; empty if the relations are equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def contains_all(df: DataFrame, rules: DataFrame, tokens: str, words: str) -> DataFrame:
    """Rows with every rule all of whose words are among the row's tokens.

    Rules are met by their first word in order, an equi-join on the exploded tokens, then checked whole.
    """
    keyed = rules.where(F.size(words) > 0).withColumn("_first", F.array_min(words))
    spread = df.withColumn("_first", F.explode(F.array_distinct(tokens)))
    return spread.join(keyed, "_first").where(F.size(F.array_except(words, tokens)) == 0).drop("_first")


def join_in_blocks(left: DataFrame, right: DataFrame, on: Sequence[str], rows: int = 2048, pairs: int = 1 << 22) -> DataFrame:
    """left.join(right, on) for keys with so many rows on both sides that their pairs are the work.

    The rows of a key are dealt into blocks of about so many, and every two blocks meet under a key of their own, in as
    many partitions as there are times so many pairs: no task has a key's pairs, and a small table of one file does not
    leave all of them to one task. A row is shuffled once for each block that it meets.
    """
    on, keys = list(on), [*on, "_bl", "_br"]
    n = left.groupBy(*on).agg(F.count("*").alias("_nl")).join(right.groupBy(*on).agg(F.count("*").alias("_nr")), on)
    total = n.agg(F.sum(F.col("_nl") * F.col("_nr"))).first()[0] or 0
    parts = int(min(2000, 1 + total // pairs))
    n = n.select(*on, F.ceil(F.col("_nl") / rows).alias("_nl"), F.ceil(F.col("_nr") / rows).alias("_nr"))
    own = lambda df, size: F.pmod(F.xxhash64(*df.columns), F.col(size))
    every = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1))
    x = left.join(n, on).withColumn("_bl", own(left, "_nl")).withColumn("_br", every("_nr")).drop("_nl", "_nr")
    y = right.join(n, on).withColumn("_br", own(right, "_nr")).withColumn("_bl", every("_nl")).drop("_nl", "_nr")
    return x.repartition(parts, *keys).hint("merge").join(y.repartition(parts, *keys), keys).drop("_bl", "_br")

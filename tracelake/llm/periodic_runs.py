"""Periodic runs of words: a phrase repeated back to back several times, by maximal pairs from LCP intervals.

Two positions of a text are a maximal pair of length l if the same l words follow both and neither the words before nor
the words after agree. A run of period q and length n is the maximal pair of length n - q at distance q, so pairs whose
length is at least three times their distance are exactly the runs that hold their period four times or more; a pair at
a multiple of the period has the same ends and gives way to the shorter one.

Suffixes are ordered by prefix doubling over all texts of an Arrow batch at once; only those whose first words (as many
as the shortest pair may have) occur twice are ordered further, as a run has no others. LCP intervals are joined bottom-up, the longest first. Each
holds its positions in order, with the word left of each (its class). When two intervals meet, each position of the
smaller looks among those of the larger within a third of the length: such occurrences overlap so far that their
distances are multiples of one period, and all but the first are of one left class, so a look at the first tells which
pairs are maximal.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.session import free_names, share_code

#: A run is at least so long, and holds its period so often.
MIN_WORDS, MIN_TIMES = 6, 4
#: Words that are ordered together; a longer text is a group of its own.
GROUP_WORDS = 1 << 19
_SPACE = r"[\x20\x09-\x0D]+"
_RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def words_of(text: Column) -> Column:
    """The words of a text, apart at ASCII white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE, -1), lambda w: w != "")


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each key among the distinct ones, and whether another key is equal."""
    _, rank, n = np.unique(key, return_inverse=True, return_counts=True)
    return rank.astype(np.int64), n[rank] > 1


def _level(rank: np.ndarray) -> np.ndarray:
    return np.append(rank, -1).astype(np.int32)


def sorted_repeats(words: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order and how many words each shares with the one before it; all that share shortest words with
    another are among them.

    words: numbers, of which the last occurs once.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    rank, twice = _ranks(words)
    levels = [_level(rank)]
    h = 1
    while 2 * h <= shortest:
        after = np.append(rank[h:], np.full(min(h, n), -1)) + 1
        rank, twice = _ranks(rank * (n + 1) + after)
        levels.append(_level(rank))
        h *= 2
    active = np.flatnonzero(twice)
    if not len(active):
        return none, none
    chosen = active
    # from here on a rank is the place of the first of equal suffixes among all, so that what is told apart stays so
    place = np.concatenate(([0], np.cumsum(np.bincount(rank))[:-1]))
    rank = place[rank]
    levels[-1] = _level(rank)
    while len(active):
        after = np.where(active + h < n, rank[np.minimum(active + h, n - 1)], -1)
        order = np.lexsort((after, rank[active]))
        active, first, then = active[order], rank[active][order], after[order]
        fresh = np.append(True, (first[1:] != first[:-1]) | (then[1:] != then[:-1]))
        group = np.append(True, first[1:] != first[:-1])
        index = np.arange(len(active))
        begin = np.maximum.accumulate(np.where(group, index, 0))
        head = np.maximum.accumulate(np.where(fresh, index, 0))
        rank[active] = first + head - begin
        h *= 2
        levels.append(_level(rank))
        alone = fresh & np.append(fresh[1:], True)
        active = active[~alone]
    chosen = chosen[np.argsort(rank[chosen], kind="stable")]
    i, j = chosen[:-1].copy(), chosen[1:].copy()
    shared = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = levels[k][np.minimum(i, n)], levels[k][np.minimum(j, n)]
        step = np.where((a == b) & (a >= 0), 1 << k, 0)
        shared, i, j = shared + step, i + step, j + step
    return chosen, np.append(0, shared)


def _shortest(times: int, least: int) -> int:
    """The length of the shortest pair that can make a run."""
    return max(1, -(-least * (times - 1) // times))


def maximal_pairs(at: np.ndarray, shared: np.ndarray, left: np.ndarray, times: int = MIN_TIMES, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, distance, length) of the maximal pairs whose length is times - 1 distances or more, and which make least words with one distance.

    at, shared: positions in suffix order and what each shares with the one before; left: the class of the word before a position.
    """
    if len(at) < 2:
        return []
    ratio = times - 1
    pairs: list[tuple[int, int, int]] = []
    edges = np.flatnonzero(shared >= _shortest(times, least))
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    other: dict[int, int] = {}  # of each interval longer than a leaf: its ends, each by the other
    held: dict[int, list[int]] = {}  # its positions, by its first leaf
    place = at.tolist()
    for e, length in zip(edges.tolist(), shared[edges].tolist(), strict=True):
        lo, hi = other.get(e - 1, e - 1), other.get(e, e)
        a = held.pop(lo, None) or [place[lo]]
        b = held.pop(e, None) or [place[e]]
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        reach = length // ratio
        for p in small:
            k = bisect_left(large, p - reach)
            m = bisect_left(large, p, k)
            if k < m:
                x = large[k]
                if left[x] != left[p] and p - x + length >= least:
                    pairs.append((x, p - x, length))
            else:
                k = bisect_right(large, p + reach, m)
                if m < k and left[large[m]] != left[p]:
                    pairs += [(p, y - p, length) for y in large[m:k] if y - p + length >= least]
        if len(small) > 16:
            large = sorted(large + small)
        else:
            for p in small:
                insort(large, p)
        held[lo] = large
        other[lo], other[hi] = hi, lo
    return pairs


def runs_of(words: np.ndarray, first: np.ndarray, times: int = MIN_TIMES, least: int = MIN_WORDS) -> np.ndarray:
    """Rows (text, start, length, period) of the runs of several texts, by text, start and period.

    words: the numbers of all their words, from 1, text after text; first: where each text begins, and the end of the last.
    """
    n_texts, n = len(first) - 1, len(words)
    # a number of its own after each text, so that nothing reaches over its end
    at = np.arange(n) + np.repeat(np.arange(n_texts), np.diff(first))
    apart = np.full(n + n_texts, 0, np.int64)
    apart[at] = words
    ends = first[1:] + np.arange(n_texts)
    apart[ends] = -1 - np.arange(n_texts)
    left = np.append(apart[-1:], apart[:-1])
    begins = first[:-1] + np.arange(n_texts)
    left[begins] = -1 - n_texts - np.arange(n_texts)
    where, shared = sorted_repeats(apart, _shortest(times, least))
    pairs = maximal_pairs(where, shared, left, times, least)
    if not pairs:
        return np.zeros((0, 4), np.int64)
    got = np.array(pairs, np.int64)
    start, distance, length = got[:, 0], got[:, 1], got[:, 2] + got[:, 1]
    # a multiple of the period has the same ends: the least distance stays
    order = np.lexsort((distance, length, start))
    start, distance, length = start[order], distance[order], length[order]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))
    start, distance, length = start[new], distance[new], length[new]
    text = np.searchsorted(begins, start, "right") - 1
    out = np.stack([text, start - begins[text], length, distance], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _numbered(words: pa.Array) -> np.ndarray:
    return pc.dictionary_encode(words).indices.to_numpy().astype(np.int64) + 1


def _groups(first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP_WORDS words together."""
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(first, first[a] + GROUP_WORDS, "right")) - 1)
        yield a, b
        a = b


def _batch(lists: pa.Array, times: int, least: int) -> tuple[pa.Array, pa.Array]:
    """The runs and the collapsed texts of an array of word lists without nulls."""
    first = lists.offsets.to_numpy().astype(np.int64)
    flat = pc.fill_null(lists.values.slice(first[0], first[-1] - first[0]), "")
    first = first - first[0]
    numbers = _numbered(flat)
    found = []
    for a, b in _groups(first):
        got = runs_of(numbers[first[a] : first[b]], first[a : b + 1] - first[a], times, least)
        got[:, 0] += a
        found.append(got)
    runs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    of = np.searchsorted(runs[:, 0], np.arange(len(first)))
    listed = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"]))
    # words of a run after its first period: counted by where such stretches open and close
    gone = np.zeros(len(numbers) + 1, np.int64)
    base = first[runs[:, 0]] + runs[:, 1]
    np.add.at(gone, base + runs[:, 3], 1)
    np.add.at(gone, base + runs[:, 2], -1)
    stays = np.cumsum(gone)[:-1] == 0
    kept = flat.filter(pa.array(stays)) if not stays.all() else flat
    ends = np.concatenate(([0], np.cumsum(stays)))[first]
    return listed, pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), kept), " ")


def collapse_runs(docs: DataFrame, words: Column, times: int = MIN_TIMES, least: int = MIN_WORDS, runs_as: str = "runs", text_as: str = "collapsed", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if not given) with the runs of each row's words and the text without their repeats.

    words: an array of words, as words_of gives. runs: array of (start, length, period), numbered from 0, by start and
    period; a run has the smallest period q that its words have, length >= max(least, times * q), and no neighbouring
    word continues it. collapsed: the words that no run holds after its first period, joined by one space. A null array
    is an empty one and a null word an empty word; empty texts have no runs and collapse to an empty text; repeated rows
    are read alike; an empty table gives an empty result. Other columns may have any names but those two. One text is
    one task's, with some 150 bytes a word.
    """
    if times < 3:
        raise ValueError("a run holds its period three times at least")
    share_code(docs.sparkSession)
    kept = docs.columns if keep is None else keep
    own = [F.col(f"`{c}`") for c in kept]
    narrow = docs.select(*own, F.coalesce(words, F.array().cast("array<string>")).alias(free_names(docs, 1)[0]))
    schema = T.StructType([*docs.select(*own).schema.fields, T.StructField(runs_as, T.ArrayType(_RUN)), T.StructField(text_as, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *_batch(lists, times, least)], names=schema.names)

    return narrow.mapInArrow(run, schema)


def with_periodic_tails(words: Column, key: Column) -> Column:
    """Words of which some rows repeat a stretch up to their end, chosen by a whole number.

    With h the CRC-32 of the number's decimal digits and g its tenth: where h ends in 0, each of the n words from a = g mod n
    on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.encode(key.cast("string"), "utf-8"))
    n = F.size(words).cast("long")
    g = F.floor(h / 10)
    a = F.when(n > 0, g % n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    a, p, rest = a.cast("int"), p.cast("int"), (n - a).cast("int")
    cycle = F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int"))
    changed = F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(cycle), F.lit(1), rest))
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(words)


def periodic_report(docs: DataFrame, words: Column, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row: doc_id, n_runs, start, length, period, exponent_milli of the run that holds its period most often, and
    the SHA-256 of the list of runs and of the collapsed text.

    Ties go to the smallest start, then the smallest period; a row without runs has four nulls. Cases as in collapse_runs.
    """
    got = collapse_runs(docs.select(F.col(f"`{id_col}`").alias("doc_id"), words.alias("w")), F.col("w"), keep=["doc_id"], **options)
    more = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(more(r, b) > 0, r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("b.length * 1000 div b.period")
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

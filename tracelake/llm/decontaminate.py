"""Benchmark decontamination by a prefix-filtered set join.

Benchmark texts are cut into patterns (whole items, or item windows). A pattern is a set of word shingles. Shingles are
ordered by rarity over all documents, and only the rarest of each pattern, its prefix, can propose a match: a pattern
of m shingles that must share ceil(c*m) of them shares at least one of its m - ceil(c*m) + 1 rarest. A proposal fixes
where the pattern would lie (its offset is subtracted; it must fit within the text), and the pattern-sized window of
the document there is verified exactly.

Benchmarks are split into blocks of a bounded number of bytes, long items into pieces. Each block is broadcast to two
scans of the documents: one counts its shingles, one searches. The first block's search yields a row for every document;
further blocks yield rows for the documents that they hit, which are then joined by id. Texts are never shuffled by a
report, and blocks cost two scans each, so the benchmark may be of any size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.session import cut, free_names, share_code

#: Bytes of benchmark text that are broadcast at once, as arrays and a table of distinct words of some 30 MB; a longer
#: item makes a block of its own where whole items are compared, else it is cut into pieces of PIECE_WORDS words.
BLOCK_BYTES = 1 << 20
PIECE_WORDS = 1 << 13
#: A-Z become a-z and every ASCII character that is no letter or digit becomes a space; bytes above 127 stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20
#: Candidates that are looked at together.
SLICE = 1 << 18


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _codes(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of k known word numbers, and where those runs begin."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    known = np.cumsum(np.concatenate(([0], ids > 0)))
    at = np.flatnonzero(known[k:] - known[:n] == k)
    return _mixed(ids[at + t] for t in range(k)), at


def _mixed(columns: Iterator[np.ndarray]) -> np.ndarray:
    code = np.uint64(0)
    for x in columns:
        code = (code ^ x.astype(np.uint64)) * _MIX
        code ^= code >> np.uint64(29)
    return code


class _Shingles:
    """Items of a block that are cut into shingles of one length, and the windows of those items, as arrays."""

    def __init__(self, k: int, items: list[tuple[int, np.ndarray]], window: int | None):
        self.k = k
        self.tokens = np.concatenate([x for _, x in items]).astype(np.int64)
        sizes = np.array([len(x) for _, x in items])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        inside = np.concatenate([np.arange(n - k + 1) + b for n, b in zip(sizes, begin, strict=True)])
        self.ids, number = np.unique(self.tokens[inside[:, None] + np.arange(k)], axis=0, return_inverse=True)
        # the number of the shingle that begins at a token
        self.number_at = np.full(len(self.tokens), -1, np.int64)
        self.number_at[inside] = number.ravel()
        width = np.minimum(window or sizes, sizes)
        n_windows = sizes - width + 1
        start = np.concatenate([np.arange(n) + b for n, b in zip(n_windows, begin, strict=True)])
        self._distinct(start, np.repeat(width, n_windows), np.repeat(np.array([i for i, _ in items]), n_windows))
        code = _mixed(self.ids[:, t] for t in range(k))
        self.order = np.argsort(code, kind="stable")
        self.code = code[self.order]
        self.bits = np.zeros(1 << _TABLE_BITS, bool)
        self.bits[self.code >> np.uint64(64 - _TABLE_BITS)] = True

    def _distinct(self, start: np.ndarray, size: np.ndarray, owner: np.ndarray) -> None:
        """One window for all that hold the same words, and the items it belongs to."""
        first, number, n = [], np.empty(len(start), np.int64), 0
        for width in np.unique(size).tolist():
            own = np.flatnonzero(size == width)
            words = np.ascontiguousarray(self.tokens[start[own][:, None] + np.arange(width)])
            _, at, which = np.unique(words.view(np.dtype((np.void, words.itemsize * width))).ravel(), return_index=True, return_inverse=True)
            first.append(own[at])
            number[own] = n + which.ravel()
            n += len(at)
        first = np.concatenate(first)
        self.start, self.size = start[first], size[first]
        pairs = np.unique(np.stack([number, owner], axis=1), axis=0)
        self.owner = pairs[:, 1]
        self.first_owner = np.searchsorted(pairs[:, 0], np.arange(n + 1))

    def owners(self, j: np.ndarray) -> list[int]:
        """The items that some of the windows belong to."""
        return sorted({i for x in np.unique(j).tolist() for i in self.owner[self.first_owner[x] : self.first_owner[x + 1]].tolist()})

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known shingles and their numbers, word for word; of shingles that share a hash each is tried."""
        code, at = _codes(ids, self.k)
        maybe = np.flatnonzero(self.bits[code >> np.uint64(64 - _TABLE_BITS)])
        code, at = code[maybe], at[maybe]
        low = np.searchsorted(self.code, code)
        n = np.searchsorted(self.code, code, "right") - low
        at = np.repeat(at, n)
        number = self.order[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        same = np.ones(len(at), bool)
        for t in range(self.k):
            same &= ids[at + t] == self.ids[number, t]
        return at[same], number[same]

    def numbers(self, j: int) -> np.ndarray:
        """The shingles of a window."""
        return self.number_at[self.start[j] : self.start[j] + self.size[j] - self.k + 1]

    def choose(self, seen: np.ndarray, containment: float) -> None:
        """The prefix of every window: the rarest shingles over all documents that no match can do without, as postings by shingle."""
        rank = np.empty(len(self.ids), np.int64)
        rank[np.lexsort((np.arange(len(self.ids)), seen))] = np.arange(len(self.ids))
        rows: list[np.ndarray] = []
        if containment >= 1:  # one shingle of each window
            for width in np.unique(self.size).tolist():
                own = np.flatnonzero(self.size == width)
                for part in np.array_split(own, -(-len(own) // 4096)):
                    of = self.number_at[self.start[part][:, None] + np.arange(width - self.k + 1)]
                    offset = rank[of].argmin(1)
                    rows.append(np.stack([of[np.arange(len(part)), offset], part, offset], axis=1))
        else:
            for j in range(len(self.start)):
                numbers = self.numbers(j)
                distinct = np.unique(numbers)
                need = math.ceil(containment * len(distinct) - 1e-9)
                rare = distinct[np.argsort(rank[distinct])][: len(distinct) - need + 1]
                offset = np.flatnonzero(np.isin(numbers, rare))
                rows.append(np.stack([numbers[offset], np.full(len(offset), j), offset], axis=1))
        post = np.concatenate(rows)
        post = post[np.argsort(post[:, 0], kind="stable")]
        self.first = np.searchsorted(post[:, 0], np.arange(len(self.ids) + 1))
        self.post = post[:, 1:]


class Block:
    """Some benchmark items, ready to be searched in documents.

    window: words of a pattern; an item of fewer words is one pattern. None: every item is one pattern.
    """

    def __init__(self, items: list[tuple[str, str]], window: int | None, shingle: int, containment: float):
        self.vocab: dict[bytes, int] = {}
        self.containment = containment
        self.names = sorted({item for item, _ in items})
        index = {item: i for i, item in enumerate(self.names)}
        by_k: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            words = words_of(text)
            if words:
                ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words])
                by_k.setdefault(min(shingle, window or len(ids), len(ids)), []).append((index[item], ids))
        self.tables = [_Shingles(k, by_k[k], window) for k in sorted(by_k)]

    def numbered(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))

    def count(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for t, table in enumerate(self.tables):
            yield t, table.find(ids)[1]

    def choose(self, seen: list[np.ndarray]) -> None:
        for table, n in zip(self.tables, seen, strict=True):
            table.choose(n, self.containment)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans of hit words (start, end) and the items they belong to."""
        items: set[str] = set()
        ids = self.numbered(words)
        hit = np.zeros(len(ids) + 1, np.int64)  # how many spans open and close at a word
        for table in self.tables:
            at, number = table.find(ids)
            n_post = table.first[number + 1] - table.first[number]
            # candidates are taken in slices, however many windows share a shingle
            edges = np.searchsorted(np.cumsum(n_post), np.arange(SLICE, int(n_post.sum()) + SLICE, SLICE), "right")
            low = 0
            tried: dict[int, set[int]] = {}
            for high in [*edges[:-1].tolist(), len(at)]:
                high = max(high, low + 1)
                if low >= len(at):
                    break
                j, start = self._candidates(table, at[low:high], number[low:high], n_post[low:high], len(ids))
                low = high
                if self.containment >= 1:
                    for o in range(int(table.size[j].max()) if len(j) else 0):
                        inside = o < table.size[j]
                        ok = ~inside
                        ok[inside] = ids[start[inside] + o] == table.tokens[table.start[j[inside]] + o]
                        j, start = j[ok], start[ok]
                    np.add.at(hit, start, 1)
                    np.add.at(hit, start + table.size[j], -1)
                    items.update(self.names[i] for i in table.owners(j))
                else:
                    for x in np.unique(j).tolist():
                        tried.setdefault(x, set()).update(np.unique(start[j == x]).tolist())
            for x, starts in tried.items():
                found = self._windows(table, x, at, number, np.array(sorted(starts)))
                for a, b in found:
                    hit[a] += 1
                    hit[b] -= 1
                if found:
                    items.update(self.names[i] for i in table.owners(np.array([x])))
        inside = np.concatenate(([False], np.cumsum(hit) > 0, [False]))
        ends = np.flatnonzero(inside[1:] != inside[:-1])
        return list(zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True)), items

    def _candidates(self, table: _Shingles, at: np.ndarray, number: np.ndarray, n_post: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows that shingles at some positions propose, and where in the text they would begin; exact ones have to fit in."""
        pos = np.repeat(at, n_post)
        row = np.arange(len(pos)) - np.repeat(np.cumsum(n_post) - n_post, n_post) + np.repeat(table.first[number], n_post)
        j, start = table.post[row, 0], pos - table.post[row, 1]
        if self.containment >= 1:
            fits = (start >= 0) & (start + table.size[j] <= n_words)
            j, start = j[fits], start[fits]
        return j, start

    def _windows(self, table: _Shingles, x: int, at: np.ndarray, number: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """Spans of the item's shingles in those item-sized windows that contain enough of them."""
        own = np.unique(table.numbers(x))
        k, size, need = table.k, int(table.size[x]), math.ceil(self.containment * len(own) - 1e-9)
        near = np.isin(number, own)
        pos, num = at[near], number[near]
        close = np.searchsorted(starts, pos)
        reach = np.minimum(np.abs(pos - starts[np.minimum(close, len(starts) - 1)]), np.abs(pos - starts[np.maximum(close - 1, 0)])) <= 2 * size
        pos, num = pos[reach].tolist(), num[reach].tolist()
        held: Counter = Counter()
        lo, told, spans = 0, 0, []
        for hi in range(len(pos)):
            held[num[hi]] += 1
            while pos[hi] + k - pos[lo] > size:
                held[num[lo]] -= 1
                if not held[num[lo]]:
                    del held[num[lo]]
                lo += 1
            if len(held) >= need:
                spans += [(p, p + k) for p in pos[max(lo, told) : hi + 1]]
                told = hi + 1
        return spans


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int | None) -> DataFrame:
    """(i, t): items, where windows are compared as pieces of bounded length that hold each window whole."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    if window is None:
        return items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                parts = [b" ".join(words[at : at + PIECE_WORDS + window - 1]).decode("utf-8", "surrogatepass") for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(parts), pa.string()), pa.array(parts, pa.string())], names=["i", "t"])

    return items.mapInArrow(run, "i string, t string")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int | None, shingle: int, containment: float, block_bytes: int) -> Iterator[Block]:
    """Blocks of about block_bytes bytes of item texts, read one at a time."""
    pieces = _pieces(benchmark, item_col, text_col, window)
    n = max(1, math.ceil((pieces.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / block_bytes))
    if n > 1:
        pieces = cut(pieces)
    for b in range(n):
        part = pieces if n == 1 else pieces.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        block = Block([(r["i"], r["t"]) for r in part.collect()], window, shingle, containment)
        if block.tables:
            yield block


def _counted(docs: DataFrame, text_col: str, block: Block) -> Block:
    """The block with its prefixes, chosen by how often each shingle occurs over all documents; summed on the executors first."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums = [np.zeros(len(t.ids), np.int64) for t in own.tables]
        for batch in batches:
            for text in batch.column(0):
                for t, numbers in own.count(own.numbered(words_of(text.as_py()))):
                    np.add.at(sums[t], numbers, 1)
        for t, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t), pa.int32()), pa.array(at, pa.int64()), pa.array(s[at], pa.int64())], names=["t", "s", "n"])

    seen = [np.zeros(len(t.ids), np.int64) for t in block.tables]
    for r in docs.select(text_col).mapInArrow(run, "t int, s long, n long").groupBy("t", "s").agg(F.sum("n").alias("n")).collect():
        seen[r["t"]][r["s"]] = r["n"]
    shared.unpersist()
    block.choose(seen)
    return block


def _search(docs: DataFrame, text_col: str, block: Block | None, keep: list[str], names: list[str], all_rows: bool) -> DataFrame:
    """The columns keep of docs with n_words, spans and items, under the given names; without all_rows of documents that are hit only."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    told = [F.col(f"`{c}`") for c in keep]
    schema = T.StructType([*docs.select(*told).schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.IntegerType())), T.StructField(names[2], T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column(len(keep)):
                words = words_of(text.as_py())
                found, owners = own.search(words) if words and own is not None else ([], set())
                counts.append(len(words))
                spans.append([y for x in merge_spans(found) for y in x])
                items.append(sorted(owners))
            cols = [*batch.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(cols, names=schema.names)
            yield out if all_rows else out.filter(pa.array([bool(x) for x in items], pa.bool_()))

    return docs.select(*told, F.col(text_col)).toDF(*keep, *free_names(docs.select(*told), 1)).mapInArrow(run, schema)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int | None = 10,
    shingle: int = 2,
    containment: float = 1.0,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, spans, items): one row per row of docs.

    spans: disjoint [start, end) pairs of hit words, flat, in order; items: the distinct ids, as sorted strings, of
    benchmark items that occur. window=None compares whole items. A null text has no words and no hits; an item with a
    null id or no words matches nothing; repeated rows each come back; repeated items count once; an empty benchmark
    hits nothing. Other columns are not read.
    """
    share_code(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    out, more = None, []
    for block in _blocks(benchmark, item_col, item_text_col, window, shingle, containment, block_bytes):
        found = _search(rows, "text", _counted(rows, "text", block), ["doc_id", "h"], ["n_words", "spans", "items"], out is None)
        if out is None:
            out = found
        else:
            more.append(cut(found.select("doc_id", "h", "spans", "items").distinct()))
    if out is None:
        out = _search(rows, "text", None, ["doc_id", "h"], ["n_words", "spans", "items"], True)
    if more:
        each = more[0]
        for x in more[1:]:
            each = each.unionByName(x)
        sums = each.groupBy(F.col("doc_id").alias("i"), F.col("h").alias("g")).agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("t"))

        def merged(spans: pa.Array) -> pa.Array:
            return pa.array([[y for p in merge_spans(list(zip(x[::2], x[1::2], strict=True))) for y in p] for x in spans.to_pylist()], pa.list_(pa.int32()))

        merged.__annotations__ = {"spans": pa.Array, "return": pa.Array}
        met = out.join(sums, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
        none = F.array().cast("array<int>"), F.array().cast("array<string>")
        spans = F.arrow_udf(merged, "array<int>")(F.concat("spans", F.coalesce("s", none[0])))
        out = met.select("doc_id", "n_words", spans.alias("spans"), F.concat("items", F.coalesce("t", none[1])).alias("items"))
    return out.select("doc_id", "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = benchmark_hits(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("x")), _add_span, lambda c: c["s"])
    out = hits.withColumn("n_hit", n_hit)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _add_span(acc: Column, x: Column) -> Column:
    """One step over flat spans: an end adds the length since the start before it."""
    start = acc["x"] < 0
    return F.struct(F.when(start, acc["s"]).otherwise(acc["s"] + x - acc["x"]).alias("s"), F.when(start, x.cast("long")).otherwise(F.lit(-1).cast("long")).alias("x"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int | None = None,
    shingle: int = 5,
    containment: float = 0.8,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of docs in which no benchmark item occurs, with docs' own columns.

    An item occurs where an item-sized window holds containment of its shingles, whatever the window holds besides.
    Null, empty and word-free texts hold no item and stay, as do null ids; repeated rows are judged alike; items with a
    null id or no words match nothing, so that all rows stay for an empty benchmark; an empty table gives an empty
    result; columns may have any names. Beyond one block of benchmark items the rows are shuffled once.
    """
    share_code(docs.sparkSession)
    out, gone, names = None, None, free_names(docs, 5)
    for block in _blocks(benchmark, item_col, item_text_col, window, shingle, containment, block_bytes):
        _counted(docs, text_col, block)
        if out is None:
            out = _search(docs, text_col, block, docs.columns, names[:3], True).where(F.size(names[2]) == 0)
        else:
            rows = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
            hit = cut(_search(rows, "text", block, ["h"], names[:3], False).select("h").distinct())
            gone = hit if gone is None else gone.union(hit)
    if out is None:
        return docs
    if gone is not None:
        # equal hashes of whole texts stand for equal texts
        out = out.join(gone.distinct().withColumnRenamed("h", names[3]), F.xxhash64(text_col) == F.col(names[3]), "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Ranked lexical search: the best documents for each of many items, by the Best Position Algorithm over impact lists.

Documents are read once into rows of the terms that items ask for, with their counts; collection statistics are summed
from these rows on the executors. Each task then cuts its rows into shards of bounded size. A shard holds, for each term,
a list of its documents by falling impact. For an item the lists of its terms are read in parallel from the top; a
document that comes up is scored at once by direct accesses to all lists of the item, which also marks its place in each.
The best position of a list is the last before its first unseen place. No unseen document can score more than the sum of
the impacts at the best positions, so reading stops as soon as that sum is strictly below the kth score found by the
task so far (at equality an unseen document could win by its id). Tasks send k rows an item, which are ranked together.

Items go out in blocks of a bounded number of bytes; each block costs one scan of the documents, which its searches
outweigh.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.decontaminate import words_of
from tracelake.session import cut, share_code

#: Bytes of item texts that are broadcast at once, some 20 MB as tables; a longer item is a block of its own.
BLOCK_BYTES = 1 << 20
#: A shard ends at so many postings or documents: some 60 MB of arrays.
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 16
#: Places of each list that are read first; every further reading takes twice as many.
FIRST_READ = 16
_LAST = np.iinfo(np.int64).max


class Items:
    """The distinct terms of some items, numbered, and the terms of each."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.vocab: dict[bytes, int] = {}
        terms: dict[str, set[int]] = {}
        for name, text in rows:
            terms.setdefault(name, set()).update(self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text))
        self.names = sorted(k for k, v in terms.items() if v)
        self.terms = [np.array(sorted(terms[k])) for k in self.names]
        self.weight = np.zeros(len(self.vocab), np.int64)
        self.n_docs = self.n_terms = 0

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        """Term weights from the number of documents, of all their terms, and of those that hold each term."""
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)

    def impacts(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What each posting adds to a score; n: the terms of its document."""
        m = 10 + (90 * n * self.n_docs) // max(1, self.n_terms)
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """Impact lists of some documents, each list by falling impact and then by id, and the postings of each document.

    ids: of the documents; first: where the postings of each begin, and the end of the last; term, impact: of postings.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray, term: np.ndarray, impact: np.ndarray, n_vocab: int):
        self.ids, self.first, self.term, self.impact = ids, first, term, impact
        doc = np.repeat(np.arange(len(ids)), np.diff(first))
        order = np.lexsort((ids[doc], -impact, term))
        self.listed, self.fall = doc[order], impact[order]
        self.begin = np.searchsorted(term[order], np.arange(n_vocab + 1))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.asked = np.zeros(n_vocab, bool)

    def best(self, terms: np.ndarray, k: int, top: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """top, the scores and ids of the best k so far, with the documents of this shard; documents of score 0 never enter."""
        terms = terms[self.begin[terms] < self.begin[terms + 1]]
        at, end = self.begin[terms].copy(), self.begin[terms + 1]  # at: past the best position of each list
        self.asked[terms] = True
        seen = np.zeros(len(self.fall), bool)
        met = np.zeros(len(self.ids), bool)
        read, depth = self.begin[terms].copy(), FIRST_READ
        scores, ids = top
        while (at < end).any():
            to = np.minimum(read + depth, end)
            docs = np.unique(self.listed[_ranges(read, to)])
            docs = docs[~met[docs]]
            met[docs] = True
            read, depth = to, 2 * depth
            # direct accesses: every posting of these documents in a list of the item
            low, n = self.first[docs], self.first[docs + 1] - self.first[docs]
            post = _ranges(low, low + n)
            mine = self.asked[self.term[post]]
            of = np.repeat(np.arange(len(docs)), n)[mine]
            post = post[mine]
            seen[self.place[post]] = True
            total = np.zeros(len(docs), np.int64)
            np.add.at(total, of, self.impact[post])
            scores, ids = _merge(scores, ids, total, self.ids[docs], k)
            for i in np.flatnonzero(at < end).tolist():
                open_ = seen[at[i] : end[i]]
                step = int(open_.argmin())
                at[i] = end[i] if open_[step] else at[i] + step
            bound = int(self.fall[np.maximum(at - 1, 0)][at < end].sum())
            if len(scores) == k and bound < scores[-1]:
                break
        self.asked[terms] = False
        return scores, ids


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All whole numbers of several ranges, range after range."""
    n = high - low
    return np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)


def _merge(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, their: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both by falling score and rising id."""
    good = more > 0 if len(scores) < k else more >= scores[-1]
    if not good.any():
        return scores, ids
    scores, ids = np.append(scores, more[good]), np.append(ids, their[good])
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[Items]:
    rows = items.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    n = max(1, math.ceil((rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / block_bytes))
    rows = cut(rows) if n > 1 else rows
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b)
        block = Items([(r["i"], r["t"]) for r in part.collect()])
        if block.names:
            yield block


def _index(docs: DataFrame, block: Items) -> DataFrame:
    """(doc_id, n, terms, counts): of every document with a term, how many it has, and the numbers and counts of those that the block asks for."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            sizes, known = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                sizes.append(len(words))
                ids = np.fromiter(map(vocab.get, words, repeat(-1)), np.int64, len(words))
                known.append(ids[ids >= 0])
            doc = np.repeat(np.arange(len(known)), [len(x) for x in known])
            keys, counts = np.unique(doc * len(vocab) + np.concatenate(known), return_counts=True) if known else (np.zeros(0, np.int64),) * 2
            first = pa.array(np.searchsorted(keys, np.arange(len(known) + 1) * len(vocab)), pa.int32())
            lists = [pa.ListArray.from_arrays(first, pa.array(x, pa.int32())) for x in (keys % len(vocab), counts)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pc.greater(out.column(1), 0))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _search(index: DataFrame, block: Items, k: int) -> DataFrame:
    """(item, doc_id, score): the best k of each task for each item."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Items = shared.value
        none = np.zeros(0, np.int64)
        top = [(none, none)] * len(own.names)
        held: list[tuple[np.ndarray, ...]] = []

        def settle() -> None:
            ids, n, sizes, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            impact = own.impacts(term, tf, np.repeat(n, sizes))
            shard = Shard(ids, np.concatenate(([0], np.cumsum(sizes))), term, impact, len(own.vocab))
            for i, terms in enumerate(own.terms):
                top[i] = shard.best(terms, k, top[i])

        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id").cast(pa.int64()), _LAST).to_numpy(zero_copy_only=False)
            sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((ids, batch.column("n").to_numpy(zero_copy_only=False), sizes, _flat(batch, "terms"), _flat(batch, "counts")))
            if sum(len(x[3]) for x in held) >= SHARD_POSTINGS or sum(len(x[0]) for x in held) >= SHARD_DOCS:
                settle()
        if held:
            settle()
        lengths = [len(s) for s, _ in top]
        ids = np.concatenate([x for _, x in top])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array(own.names, object), lengths), pa.string()), pa.array(ids, mask=ids == _LAST), pa.array(np.concatenate([s for s, _ in top]))
        ], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item string, doc_id long, score long")


def ranked_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents that score highest, ranked from 1, equal scores by id.

    Terms are runs of letters and digits of ASCII and of all characters beyond it, A-Z lower-cased. With N the documents
    that have terms, L their terms, df the documents that hold a term, tf its occurrences in a document of n terms: a term
    weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), a document's measure is m = 10 + 90 n N div L, and its score the sum
    of w * (10^9 tf div (1000 tf + 8 m)) over the item's terms, once each. Documents of score 0 are not ranked: an item
    has fewer rows then, or none. Ids of documents are whole numbers; null texts and texts without terms count for
    nothing; a null id comes after all others among equal scores; repeated rows are ranked each. Rows that repeat an item
    id are one item; items with a null id, a null text or no term have no rows; empty tables give an empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession
    share_code(spark)
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = items.schema[item_col].dataType
    out = spark.createDataFrame([], "item string, doc_id long, score long")
    for block in _blocks(items, item_col, item_text_col, block_bytes):
        index = cut(_index(narrow, block))
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(block.vocab), np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the block
            df[r["t"]] = r["count"]
        block.weigh(n_docs, n_terms, df)
        out = out.unionByName(_search(index, block, k))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")

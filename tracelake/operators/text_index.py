"""A written inverted index that changes at the cost of what changed.

Each refresh adds a segment: the postings of the documents that are new or changed, in buckets by term, and one row a
document of the refresh, in buckets by id, with its length, or none if it was removed. Such a row puts all that older
segments say of the document out of use. Of a document only the newest segment counts, so a search reads the buckets of
its terms, and the rows of documents that segments after the first touched. How many documents there are, and how many
terms they have, is kept as sums that each refresh changes by what it adds and takes away; how many documents hold a term
is counted over the postings that are in use. A compaction writes one segment of what is in use. Refreshes and
compactions are commits: a search sees whole ones only.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.text import postings, rank_bm25, tokens
from tracelake.sources.commits import CommitLog, child_folders, delete_folder

_POSTINGS = "term string, id {id}, tf long, n_terms int, segment string, bucket int"
_DOCS = "id {id}, n_terms int, segment string, bucket int"


def _bucket(of: str, n: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(n)).cast("int")


class TextIndex:
    """An index below path. buckets and id_type count for a new index; one that is there keeps its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, id_type: str = "bigint"):
        self.spark, self.path = spark, path
        self.log = CommitLog(spark, f"{path}/_log")
        self._new = {"segments": [], "n": 0, "terms": 0, "buckets": buckets, "id_type": id_type}

    def state(self) -> dict:
        """The newest commit: segments, the number n of documents and of all their terms."""
        return self.log.latest()[1] or self._new

    def _read(self, state: dict, kind: str) -> DataFrame:
        schema = (_POSTINGS if kind == "postings" else _DOCS).format(id=state["id_type"])
        if not state["segments"]:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/{kind}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/segment={s}" for s in state["segments"]])

    def _newest(self, docs: DataFrame) -> DataFrame:
        """(id, n_terms, segment) of each document in docs as its newest segment has it; n_terms is null for removed ones."""
        best = docs.groupBy("id").agg(F.max(F.struct("segment", "n_terms")).alias("b"))
        return best.select("id", "b.n_terms", "b.segment")

    def _in_use(self, state: dict, rows: DataFrame) -> DataFrame:
        """Postings whose segment is the newest that names their document."""
        later = self._newest(self._read(state, "docs").where(F.col("segment") > F.lit(min(state["segments"], default=""))))
        met = rows.join(later.select("id", F.col("segment").alias("_last")), "id", "left")
        return met.where(F.col("_last").isNull() | (F.col("_last") == F.col("segment"))).drop("_last")

    def _write(self, segment: str, post: DataFrame, docs: DataFrame, n: int) -> None:
        """post: (id, n_terms, bucket, terms, tfs), shuffled as lists, which take a fraction of single postings; docs: (id, n_terms)."""
        rows = post.hint("rebalance", F.col("bucket")).select("id", "n_terms", "bucket", F.inline(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("tfs").alias("tf"))))
        rows = rows.select("term", "id", F.col("tf").cast("long").alias("tf"), "n_terms", "bucket")
        rows.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        docs.withColumn("bucket", _bucket("id", n)).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/docs/segment={segment}")

    def refresh(self, changed: DataFrame, removed: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> dict:
        """Take in documents that are new or have a new text, and drop those whose ids are in removed; the new state comes back.

        Ids are unique in changed; one that is in both is taken in. Null ids are refused. A null text has no terms. Ids
        that are not there can be removed without effect.
        """
        own = changed.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        if not own.where("id is null").limit(1).isEmpty():
            raise ValueError("a document has no id")
        while True:
            last, state = self.log.latest()
            state = state or self._new
            n = state["buckets"]
            segment = f"{last + 1:012d}-{uuid.uuid4().hex}"
            lengths = own.select(F.col("id").cast(state["id_type"]).alias("id"), F.size(tokens(F.col("text"))).alias("n_terms"))
            if removed is not None:
                gone = removed.select(F.col(f"`{id_col}`").cast(state["id_type"]).alias("id")).where("id is not null").distinct().join(lengths, "id", "left_anti")
                lengths = lengths.unionByName(gone.withColumn("n_terms", F.lit(None).cast("int")))
            post = postings(own, "id", "text", n).withColumn("id", F.col("id").cast(state["id_type"]))
            self._write(segment, post, lengths, n)
            fresh = self._read(state | {"segments": [segment]}, "docs")
            # of the documents before, those of the touched buckets are read
            touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most as many as there are buckets
            before = self._newest(self._read(state, "docs").where(F.col("bucket").isin(touched))).join(fresh.select("id"), "id", "left_semi").where("n_terms is not null")
            sums = lambda df: df.agg(F.count("n_terms"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
            (n_new, t_new), (n_old, t_old) = sums(fresh), sums(before)
            if n_new != fresh.where("n_terms is not null").select("id").distinct().count():
                raise ValueError("an id is there twice")
            entry = state | {"segments": [*state["segments"], segment], "n": state["n"] + n_new - n_old, "terms": state["terms"] + t_new - t_old}
            if self.log.commit(last + 1, entry):
                return entry

    def search(self, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(query, id, score): the k best documents of every query (query, text) by BM25; the same as over the texts themselves."""
        state = self.state()
        wanted = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        terms = wanted.select("term").distinct()
        buckets = [r[0] for r in terms.select(_bucket("term", state["buckets"])).distinct().collect()]  # at most as many as there are buckets
        rows = self._read(state, "postings").where(F.col("bucket").isin(buckets)).join(terms, "term", "left_semi")
        hits = self._in_use(state, rows).select("id", F.col("n_terms").alias("len"), "term", "tf")
        stats = self.spark.createDataFrame([(state["n"], state["terms"] / max(1, state["n"]))], "_n long, _avg double")
        return rank_bm25(hits, stats, wanted, k, k1, b)

    def compact(self) -> dict:
        """Write what is in use as one segment; a refresh that comes in between is kept and the compaction begun again."""
        while True:
            last, state = self.log.latest()
            if state is None or len(state["segments"]) < 2:
                return state or self._new
            segment = f"{last + 1:012d}-{uuid.uuid4().hex}"
            docs = self._newest(self._read(state, "docs")).where("n_terms is not null").select("id", "n_terms")
            used = self._in_use(state, self._read(state, "postings"))
            self._write(segment, used.select("id", "n_terms", "bucket", F.col("term").alias("terms"), F.array(F.col("tf").cast("int")).alias("tfs")), docs, state["buckets"])
            entry = state | {"segments": [segment]}
            if self.log.commit(last + 1, entry):
                return entry

    def sweep(self, older_than: datetime) -> int:
        """Delete segments that the newest commit doesn't name and that were begun before a time; how many went."""
        named, gone = set(self.state()["segments"]), set()
        for kind in ("postings", "docs"):
            for name in child_folders(self.spark, f"{self.path}/{kind}", older_than):
                if name.removeprefix("segment=") not in named:
                    delete_folder(self.spark, f"{self.path}/{kind}/{name}")
                    gone.add(name)
        return len(gone)

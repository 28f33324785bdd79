"""From raw documents to a training mix: five stages, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.decontaminate import decontaminate
from tracelake.llm.langid import keep_identified
from tracelake.llm.mixing import mix
from tracelake.llm.simhash import simhash_dedup
from tracelake.llm.substring_dedup import cut_passages
from tracelake.session import ensure_checkpoint_dir, table


# Of every stage: columns may have any names beside those of documents, which all come back; an empty table gives an
# empty result; ids are whole numbers.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay, and lang becomes the language told.

    Null texts and texts without a letter go. Null ids, languages and sources are no bar; repeated rows are told alike.
    """
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows that repeat an id count once, the first by text; of rows with a null id one of each text stays; null and empty
    texts are copies of each other.
    """
    return simhash_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds are cut out; documents with nothing left go.

    Rows with a null id or text stay as they are; rows that repeat an id are cut alike.
    """
    return cut_passages(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; items with a null id or no words match nothing.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet tempered source, language and topic shares, with each row's sample_prob.

    Nulls are categories of their own; rows are drawn by their id, those without one by their text.
    """
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
]

#: Covering hashes, chained alignments and raking have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

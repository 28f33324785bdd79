"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.chat import chain_by_turn, conversation_digests, format_conversations
from tracelake.llm.cotraining import quality_scores
from tracelake.llm.decontaminate import contamination_report
from tracelake.llm.exact_dedup import exact_groups
from tracelake.llm.html_extract import extract_pages
from tracelake.llm.langid import language_report
from tracelake.llm.lexical_search import ranked_documents
from tracelake.llm.license_scan import license_scan
from tracelake.llm.license_texts import TEMPLATES
from tracelake.llm.mixing import mixing_plan
from tracelake.llm.oracles import ORACLE_SQL  # noqa: F401
from tracelake.llm.periodic_runs import periodic_report, with_periodic_tails, words_of
from tracelake.llm.quality_rules import quality_report
from tracelake.llm.simhash import simhash_groups
from tracelake.llm.substring_dedup import repeated_passages
from tracelake.session import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), TEMPLATES)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_plan(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(table(spark, sf_dir, "documents"))
    return report.withColumns({c: F.round(c, 6) for c in ("js_chars", "js_common")})


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return conversation_digests(format_conversations(chain_by_turn(conversations.unionByName(extra))))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", words_of(F.col("text")).alias("words"))
    return periodic_report(words, with_periodic_tails(F.col("words"), F.col("doc_id")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="last")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat": op8_chat,
    "op9_decontaminate": op9_decontaminate,
    "op10_html_extract": op10_html_extract,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_dedup": op13_exact_dedup,
}

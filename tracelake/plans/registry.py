"""All registered queries of the library, family by family."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "d11_turns"
FAMILIES: list[str] = ["relational", "activity", "logs", "text", "analysis", "sources", "streams"]

#: Columns of the SQL whose DuckDB type is wider or narrower than Spark's: counts come as HUGEINT, bit counts as TINYINT.
CASTS: dict[str, dict[str, str]] = {
    "c18_aggregates": {"errors": "BIGINT"},
    "c23_islands": {"island": "BIGINT"},
    "c27_prefix_budget": {"returned": "BIGINT"},
    "d16_attachment_stats": {"timeouts": "BIGINT"},
    "d18_retro": {"asked": "BIGINT", "long": "BIGINT"},
    "d21_author_hygiene": {"flagged": "BIGINT"},
    "e13_coverage_by_file": {"failures": "BIGINT"},
    "g11_compare_sides": {"different": "BIGINT", "missing": "BIGINT"},
    "h5_classify_words": {"number": "BIGINT"},
    "j1_hamming": {"bits": "INTEGER"},
    "j2_scenes": {"max_change": "INTEGER"},
    "j3_refine": {"max_change": "INTEGER"},
    "j6_near_dupes": {"bits": "INTEGER"},
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for family in FAMILIES:
        found |= import_module(f"tracelake.plans.{family}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for family in FAMILIES:
        found |= import_module(f"tracelake.plans.{family}").ORACLE_SQL
    for name, casts in CASTS.items():
        found[name] = f"SELECT * REPLACE ({', '.join(f'{c}::{t} AS {c}' for c, t in casts.items())}) FROM ({found[name]})"
    return found

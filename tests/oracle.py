"""Holds registered queries against their SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, got.fetchall()


def difference(df, sf_dir: str, sql: str) -> str:
    """Empty if the rows agree, as bags; else what differs."""
    names, want = sql_rows(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    have = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    if len(have) != len(want):
        return f"{len(have)} rows against {len(want)}; {[r for r in have if r not in set(want)][:2]} {[r for r in want if r not in set(have)][:2]}"
    bad = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else ""

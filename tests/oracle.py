"""Run a query and its DuckDB oracle over the same tables and compare all values."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return bytes(value) if isinstance(value, bytearray) else value


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None, or what differs."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = rows(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        odd = sorted(set(mine) - set(theirs))[:2], sorted(set(theirs) - set(mine))[:2]
        return f"{name}: {len(mine)} and {len(theirs)} rows; only in Spark {odd[0]}; only in SQL {odd[1]}"
    return None

"""Holds a query's rows against DuckDB's, column by column, without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def rows(names: list[str], got) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=repr)


def differences(df, sql: str, con) -> str:
    """What differs, or nothing."""
    want = con.execute(sql)
    want_names = [d[0] for d in want.description]
    a, b = rows(df.columns, df.collect()), rows(want_names, want.fetchall())
    if sorted(df.columns) != sorted(want_names):
        return f"columns {df.columns} and {want_names}"
    if a != b:
        more = [x for x in a if x not in set(b)][:2]
        less = [x for x in b if x not in set(a)][:2]
        return f"{len(a)} and {len(b)} rows; only here {str(more)[:300]}; only in SQL {str(less)[:300]}"
    return ""

"""Run every registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from glob import glob
from os.path import basename

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else ("float", value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(con, df, sql: str) -> str | None:
    """None when the frame and the SQL agree, else what differs."""
    mine = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if mine != theirs:
        only_mine, only_theirs = list((mine - theirs).elements()), list((theirs - mine).elements())
        return f"{sum(mine.values())} against {sum(theirs.values())} rows; {only_mine[:3]} against {only_theirs[:3]}"
    return None

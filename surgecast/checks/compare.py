"""Run a registered query and its SQL twin and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float) and value != value:
        return None
    if value is pd.NaT:
        return None
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime().replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql: str, limit: int = 5) -> list[str]:
    """Differences between the two results, empty when they agree."""
    ours_cols, ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs_cols, theirs = rows_of(names, cur.fetchall())
    if ours_cols != theirs_cols:
        return [f"columns {ours_cols} != {theirs_cols}"]
    found = []
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} != {len(theirs)}")
    left, right = set(map(repr, ours)), set(map(repr, theirs))
    found += [f"only spark: {r}" for r in sorted(left - right)[:limit]]
    found += [f"only sql:   {r}" for r in sorted(right - left)[:limit]]
    if not found and ours != theirs:
        found.append("rows differ in multiplicity or type")
    types = []
    if ours:
        for name, a, b in zip(ours_cols, ours[0], theirs[0]):
            if a is not None and b is not None and type(a) is not type(b):
                types.append(f"type of {name}: {type(a).__name__} != {type(b).__name__}")
    return found + types

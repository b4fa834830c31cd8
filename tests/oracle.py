"""Run a query in Spark and its SQL in DuckDB, and compare rows."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def differences(spark, sf_dir: str, name: str, query, sql: str) -> list[str]:
    df = query(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    con = connect(sf_dir).execute(sql)
    names = [d[0] for d in con.description]
    theirs = rows(names, con.fetchall())
    out = []
    if sorted(names) != sorted(df.columns):
        out.append(f"{name}: columns {sorted(df.columns)} and {sorted(names)}")
    elif len(ours) != len(theirs):
        out.append(f"{name}: {len(ours)} and {len(theirs)} rows")
    else:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        if bad:
            out.append(f"{name}: {len(bad)} of {len(ours)} rows differ, such as {bad[0]}")
    return out

"""Comparing a query with SQL over the same Parquet tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    return round(x, 6) if isinstance(x, float) and math.isfinite(x) else x


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(sql: str, sf_dir: str) -> list[tuple]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'").fetchall()
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in out.fetchall()), key=repr)

"""A query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    return x


def differences(spark, sf_dir: str, f, sql: str) -> str:
    """Empty if columns, types and rows (in any order) are the same."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = f(spark, sf_dir)
    rel = con.sql(sql)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {df.columns} {rel.columns}"
    odd = {c: (k, kinds[c]) for c, k in df.dtypes if KINDS.get(k, kinds[c]) != kinds[c]}
    if odd:
        return f"types {odd}"
    names = sorted(df.columns)
    mine = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in names]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if mine == theirs:
        return ""
    bad = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b]
    return f"rows {len(mine)} {len(theirs)}, first {bad[:2]}"


SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

"""Spark rows against DuckDB rows, regardless of order."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


#: Types that count as the same.
KIND = {"bigint": "long", "long": "long", "int": "int", "integer": "int", "double": "double", "varchar": "string", "string": "string", "boolean": "boolean"}


def differences(spark_df, con, sql: str) -> str:
    """Empty if rows, column names and types agree."""
    names = sorted(spark_df.columns)
    got = Counter(tuple(plain(r[n]) for n in names) for r in spark_df.collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} != {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, (str(x).lower() for x in rel.types)))
    odd = {n: (t, kinds[n]) for n, t in spark_df.dtypes if KIND.get(t, t) != KIND.get(kinds[n], kinds[n])}
    at = [rel.columns.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if got != want:
        return f"{sum(got.values())} rows != {sum(want.values())}; only Spark: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}"
    return f"types {odd}" if odd else ("" if want else "no rows")

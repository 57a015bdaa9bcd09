"""Compares queries with their SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import datetime
import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET threads TO 4")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    return x


def compare(df, sql: str, con) -> str:
    """What differs, or an empty text."""
    names = sorted(df.columns)
    got = Counter(tuple(_value(r[n]) for n in names) for r in df.collect())
    result = con.sql(sql)
    if sorted(result.columns) != names:
        return f"columns {names} and {sorted(result.columns)}"
    order = [result.columns.index(n) for n in names]
    kinds = {n: str(t) for n, t in zip(result.columns, result.types)}
    want = Counter(tuple(_value(r[i]) for i in order) for r in result.fetchall())
    if got != want:
        only, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"{sum(got.values())} and {sum(want.values())} rows; only in Spark {only}; only in SQL {missing}"
    spark_kinds = dict(df.dtypes)
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = {n: (spark_kinds[n], kinds[n]) for n in names if pairs.get(spark_kinds[n], kinds[n]) != kinds[n]}
    return f"types {odd}" if odd else ""

"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

KINDS = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b and type(a) is type(b)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """First difference in names, types, number of rows or values; None when equal."""
    cur = con.execute(sql)
    described = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cur.description}
    kinds = dict(df.dtypes)
    if kinds != described:
        return f"schema {sorted(kinds.items())} <> {sorted(described.items())}"
    names = sorted(kinds)
    at = [list(described).index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=_key)
    ours = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows <> {len(theirs)}"
    for a, b in zip(ours, theirs):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"{names}\n  spark  {a}\n  duckdb {b}"
    return None

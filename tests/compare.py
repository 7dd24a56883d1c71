"""Runs a registered query on Spark and its SQL on DuckDB and compares the results as multisets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")
FAMILIES = {
    "bigint": "int64", "int": "int32", "string": "text", "double": "double", "float": "float",
    "boolean": "bool", "BIGINT": "int64", "INTEGER": "int32", "VARCHAR": "text",
    "DOUBLE": "double", "FLOAT": "float", "BOOLEAN": "bool",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, sf_dir: str, query, sql: str) -> int:
    """Asserts equality and returns the number of rows."""
    df = query(spark, sf_dir)
    result = duck(sf_dir).execute(sql)
    theirs = {d[0]: FAMILIES.get(str(d[1]), str(d[1])) for d in result.description}
    ours = {n: FAMILIES.get(t, t) for n, t in df.dtypes}
    assert ours == theirs, f"columns differ: {ours} {theirs}"
    got = rows(df.columns, df.collect())
    expected = rows(list(theirs), result.fetchall())
    if got != expected:
        missing, extra = expected - got, got - expected
        raise AssertionError(
            f"{sum(missing.values())} rows missing, {sum(extra.values())} extra of "
            f"{sum(expected.values())}; columns {sorted(ours)}\nmissing {list(missing)[:4]}\n"
            f"extra {list(extra)[:4]}")
    return sum(got.values())

"""Every query that has SQL gives the same rows as the SQL on DuckDB."""

import pytest
from compare import TESTDATA, compare

import __spark_entry__ as entry

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    assert compare(spark, f"{TESTDATA}/sf0.001", QUERIES[name], SQL[name]) > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["image_id", "y", "x", "r8", "g8", "b8", "a8"]
    assert df.count() > 0


def test_inventory_is_covered():
    ids = {name.split("_")[0] for name in QUERIES}
    expected = {f"J{i:02}" for i in range(1, 24)} | {f"E{i:02}" for i in range(1, 27)} \
        | {f"T{i}" for i in range(1, 6)} | {f"D{i}" for i in range(1, 8)}
    assert expected <= ids

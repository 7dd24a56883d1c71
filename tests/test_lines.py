"""Scan lines: assembly without an exchange of pixels, and reads of few directories."""

import pytest
from pyspark.sql import functions as F

from lumigrid.operators import resolve
from lumigrid.sources import tables

LINES = [  # file, part, channel, y, line
    (1, 0, 0, 0, [1.0, 2.0, 3.0]), (1, 0, 1, 0, [4.0, None]), (1, 0, 2, 0, [5.0, 6.0, 7.0]), (1, 1, 0, 0, [0.5, None, None, 0.25]),
    (1, 0, 0, 1, [8.0]), (1, 0, 1, 1, []), (1, 0, 2, 1, [None, 9.0]), (1, 0, 5, 1, [99.0]),
    (2, 0, 0, 0, [1.5]), (3, 0, 0, 0, [7.5])]
RESOLVED = [(1, "a", 0, 0, 1, 2, 0, 1), (2, "gray", 0, 0, 0, 0, None, 0)]
RESOLVED_SCHEMA = "file_id long, layer string, part_idx int, r int, g int, b int, a int, alpha int"


def lines(spark):
    return spark.createDataFrame(LINES, "file_id long, part_idx int, channel_idx int, y int, line array<float>")


def resolved(spark):
    return spark.createDataFrame(RESOLVED, RESOLVED_SCHEMA)


def rows(df):
    return sorted(map(str, df.select("file_id", "layer", "y", "x", "r", "g", "b", "a").collect()))


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("alpha", ["part_idx", "alpha"])
def test_lines_give_the_pixels_of_their_samples(spark, alpha):
    want = resolve.assemble_pixels(tables.from_scanlines(lines(spark)), resolved(spark), alpha)
    got = resolve.assemble_pixels(lines(spark), resolved(spark), alpha)
    assert got.schema.simpleString() == want.schema.simpleString() and rows(got) == rows(want) and got.count() > 5


def test_no_lines(spark):
    assert resolve.assemble_pixels(lines(spark).limit(0), resolved(spark)).count() == 0
    assert resolve.assemble_pixels(lines(spark), resolved(spark).limit(0)).count() == 0


def test_extract_channel(spark):
    one = spark.createDataFrame([(1, "l", "c", 0, 1), (3, "l", "c", 0, 0)],
                                "file_id long, layer string, channel string, part_idx int, channel_idx int")
    got = resolve.extract_channel(lines(spark), one)
    want = resolve.extract_channel(tables.from_scanlines(lines(spark)), one)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 2


def test_bucketed_lines_are_assembled_in_place(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS lines_by_place")
    try:
        saved = tables.save_lines(lines(spark), "lines_by_place", 4, str(tmp_path / "lines"))
        got = resolve.assemble_pixels(saved, resolved(spark))
        plan = executed(got)
        assert rows(got) == rows(resolve.assemble_pixels(lines(spark), resolved(spark)))
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.sql("DROP TABLE IF EXISTS lines_by_place")


@pytest.mark.parametrize("table", ["scanlines", "samples"])
def test_only_directories_of_wanted_files_are_read(spark, tmp_path, table):
    many = spark.range(400).select(F.col("id").alias("file_id"), F.lit(0).alias("part_idx"), F.lit(0).alias("channel_idx"),
                                   F.lit(0).alias("y"), F.array(F.col("id").cast("float")).alias("line"))
    path = str(tmp_path / table)
    tables.write_table(many if table == "scanlines" else tables.from_scanlines(many), path, table)
    stored = tables.read_table(spark, path, table, keep_bucket=True)
    one = spark.createDataFrame([(7, "l", "c", 0, 0)],
                                "file_id long, layer string, channel string, part_idx int, channel_idx int")
    got = resolve.extract_channel(stored, one)
    plan = executed(got)
    assert "dynamicpruning" in plan
    assert [(r["file_id"], r["x"], r["r"]) for r in got.collect()] == [(7, 0, 7.0)]
    both = resolved(spark).filter("file_id = 2")
    assert "dynamicpruning" in executed(resolve.assemble_pixels(stored, both))


@pytest.mark.parametrize("kind", ["lines", "samples"])
def test_rows_of_several_views_come_from_one_scan(spark, kind, monkeypatch):
    table = lines(spark) if kind == "lines" else tables.from_scanlines(lines(spark))
    looked = []
    plain = resolve._looked_up
    monkeypatch.setattr(resolve, "_looked_up", lambda t, w: looked.append(t) or plain(t, w))
    single = spark.createDataFrame([(1, "a", "Z", 0, 0), (1, "a", "q", 1, 0)], "file_id long, layer string, channel string, part_idx int, channel_idx int")
    none = single.filter("channel = 'nothing'")
    found = resolve.used_rows(table, colour=resolved(spark), gray=single, depth=none)
    assert len(looked) == 1
    ids = lambda df: sorted({(r["file_id"], r["part_idx"], r["channel_idx"]) for r in df.collect()})
    assert ids(found["colour"]) == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (2, 0, 0)]
    assert ids(found["gray"]) == [(1, 0, 0), (1, 1, 0)] and found["depth"].count() == 0
    assert found["gray"].columns == table.columns
    want = resolve.assemble_pixels(table, resolved(spark))
    assert rows(resolve.assemble_pixels(found["colour"], resolved(spark))) == rows(want)

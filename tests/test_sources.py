from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumigrid.operators import catalog, reports, resolve
from lumigrid.scale import drop_intermediates, materialize, salted_join, shared_dir
from lumigrid.sources import fixtures, listing, tables


def test_inventory(spark, tmp_path):
    for name in ["a.exr", "B.EXR", "c.Exr", "d.png", "e", "f.exr.bak", ".exr", "g.exrx"]:
        (tmp_path / name).write_bytes(b"12345")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "h.exr").write_bytes(b"1")
    rows = listing.file_inventory(spark, str(tmp_path)).collect()
    assert {(r.file_name, r.size_bytes) for r in rows} == {("a.exr", 5), ("B.EXR", 5), ("c.Exr", 5)}
    plan = listing.file_inventory(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_pixel_table_round_trip(spark, tmp_path):
    pixels = fixtures.pixels(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "pixels")
    tables.write_table(pixels, path, "pixels")
    back = tables.read_table(spark, path, "pixels")
    assert back.exceptAll(pixels).count() == 0 and back.count() == pixels.count()
    two = tables.read_table(spark, path, "pixels", images=[1, 3])
    assert {r.image_id for r in two.select("image_id").distinct().collect()} == {1, 3}
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    tone = two.select("r")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<image_id:bigint,r:float>" in tone


@pytest.mark.parametrize("name", ["files", "channels", "attrs"])
def test_catalog_round_trip(spark, tmp_path, name):
    df = getattr(fixtures, name)(spark, "/root/testdata/sf0.001")
    tables.write_table(df, str(tmp_path / name), name)
    back = tables.read_table(spark, str(tmp_path / name), name)
    assert back.count() == df.count() and back.exceptAll(df).count() == 0


def test_scanlines(spark):
    samples = fixtures.samples(spark, "/root/testdata/sf0.001")
    lines = tables.to_scanlines(samples)
    assert lines.count() * fixtures.WIDTH == samples.count()
    assert tables.from_scanlines(lines).select(samples.columns).exceptAll(samples).count() == 0


def test_salted_join(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"))
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k BIGINT, n STRING")
    assert salted_join(big, small, ["k"], ["i"]).exceptAll(big.join(small, "k")).count() == 0
    assert salted_join(big, small, ["k"], ["i"], how="left").count() == 1000
    with pytest.raises(ValueError):
        salted_join(big, small, ["k"], ["i"], how="full")


class FakeSession:
    """A session with a given master and checkpoint setting."""

    def __init__(self, master, configured=None):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": configured}, self
        self.master, self.chosen = master, None

    def getCheckpointDir(self):
        return self.chosen

    def setCheckpointDir(self, folder):
        self.chosen = folder


def test_shared_folder():
    assert shared_dir(FakeSession("spark://x", "/shared/")) == "/shared"
    with pytest.raises(RuntimeError):
        shared_dir(FakeSession("spark://x"))
    local = FakeSession("local[2]")
    assert shared_dir(local) == shared_dir(local) == local.chosen


def test_written_tables_are_planned_by_their_decoded_size(spark):
    """A million rows of few values are next to nothing in files, yet no table to broadcast."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1m")
    try:
        few = materialize(spark.range(100).select("id", F.lit("x" * 32).alias("t")))
        many = materialize(spark.range(1 << 20, numPartitions=1).select((F.col("id") % 9).alias("id"), F.lit("x" * 32).alias("t")))
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        big = spark.range(1 << 22)
        assert "BroadcastHashJoin" in plan(big.join(few, "id"))
        assert "SortMergeJoin" in plan(big.join(many, "id"))
        grouped = many.select(F.col("id").alias("k"), "t").groupBy("k").agg(F.max("t"))
        assert "SortMergeJoin" in plan(big.join(grouped, big["id"] == grouped["k"]))
    finally:
        spark.conf.set(limit, before)


def test_materialize(spark):
    written = materialize(spark.range(5).withColumn("k", F.lit("x")))
    assert written.count() == 5 and written.columns == ["id", "k"]
    assert "Range" not in written._jdf.queryExecution().executedPlan().toString()


def test_scan_lines_keep_places_across_holes(spark):
    rows = [(1, 0, 0, 0, 0, 1.0), (1, 0, 0, 0, 2, 3.0), (1, 0, 0, 1, 1, 5.0)]
    samples = spark.createDataFrame(rows, "file_id long, part_idx int, channel_idx int, y int, x int, v float")
    lines = tables.to_scanlines(samples)
    assert {r["y"]: r["line"] for r in lines.collect()} == {0: [1.0, None, 3.0], 1: [None, 5.0]}
    assert sorted(map(tuple, tables.from_scanlines(lines).collect())) == rows


def test_salted_join_measures_its_small_side(spark, capsys):
    big = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    plans = []
    for limit in (1 << 20, 0):
        joined = salted_join(big, small, ["k"], ["v"], limit=limit)
        assert joined.count() == 667
        joined.explain()
        plans.append(capsys.readouterr().out)
    assert "BroadcastHashJoin" in plans[0] and "_salt" not in plans[0]
    assert "SortMergeJoin" in plans[1] and "_salt" in plans[1]


def test_intermediates_can_be_dropped(spark):
    path = materialize(spark.range(3)).inputFiles()[0].rpartition("/")[0].removeprefix("file:")
    assert Path(path).exists()
    drop_intermediates(spark)
    assert not Path(path).exists()


def test_catalogs_of_few_bytes_are_not_broadcast(spark, tmp_path):
    """Repeating values make files far smaller than their rows; the driver would have to hold these."""
    n = 100_000
    path = str(tmp_path / "files")
    spark.range(n).selectExpr("id AS file_id", "concat('/shots/', repeat('deep/', 40), id % 10, '.exr') AS path",
                              "id AS size_bytes").write.parquet(path)
    files = spark.read.parquet(path)
    channels = files.selectExpr("file_id", "0 AS part_idx", "0 AS channel_idx", "'a.R' AS full_name",
                                "CAST(NULL AS STRING) AS part_name")
    thumbs = files.filter("file_id % 10 > 0").selectExpr("file_id", "10 AS t_width", "10 AS t_height")
    for made, rows in ((reports.gallery(files, channels, thumbs), n * 9 // 10),
                       (reports.unreadable_files(files, thumbs), n // 10), (catalog.best_layer(channels), n)):
        assert made.count() == rows
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_requests_of_many_files_are_not_broadcast(spark, tmp_path):
    """As written they are below the limit; the driver's hash relation of them is above it."""
    n = 100_000
    path = str(tmp_path / "channels")
    spark.range(n).selectExpr("id AS file_id", "0 AS part_idx", "CAST(NULL AS STRING) AS part_name", "0 AS channel_idx",
                              "'a.R' AS full_name", "16 AS width", "50 AS height").write.parquet(path)
    channels = spark.read.parquet(path)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "4m")
    try:
        made = resolve.resolve_rgba(channels, channels.selectExpr("file_id", "'a' AS layer"))
        assert made.filter("source = 'layer'").count() == n
        made.collect()
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)

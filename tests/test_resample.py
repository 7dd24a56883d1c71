import numpy as np
import pytest

from lumigrid.operators import resample


def image(spark, width, height, image_id=1):
    """Red is the row, green the column."""
    return spark.range(width * height).selectExpr(
        f"cast({image_id} as bigint) image_id", f"cast(id div {width} as int) y",
        f"cast(id % {width} as int) x", f"cast(id div {width} as float) r",
        f"cast(id % {width} as float) g", "cast(0 as float) b", "cast(1 as float) a")


def sources(target, scale, size):
    picked = (np.arange(target, dtype=np.float32) / scale).astype(np.int64)
    return np.minimum(picked, size - 1)


def expected(width, height, scale, t_height=None):
    scale = np.float32(scale)
    tw = int(np.float32(width) * scale)
    th = t_height if t_height else int(np.float32(height) * scale)
    ys, xs = sources(th, scale, height), sources(tw, scale, width)
    return {(y, x): (int(ys[y]), int(xs[x])) for y in range(th) for x in range(tw)}


def cells(df):
    rows = df.collect()
    got = {(r.y, r.x): (int(r.r), int(r.g)) for r in rows}
    assert len(got) == len(rows)
    return got


def dims(spark, *sizes):
    return spark.createDataFrame([(i + 1, w, h) for i, (w, h) in enumerate(sizes)],
                                 "image_id BIGINT, width INT, height INT")


@pytest.mark.parametrize("width, height, thumb", [
    (1920, 1080, 150), (2200, 1237, 150), (100, 200, 150), (10, 20, 150), (37, 150, 150), (3, 1, 150),
    (333, 7, 5)])
def test_fixed_height(spark, width, height, thumb):
    scaled = resample.resample(image(spark, width, height),
                               resample.thumb_dims(dims(spark, (width, height)), thumb))
    assert cells(scaled) == expected(width, height, np.float32(thumb) / np.float32(height), thumb)


def test_zero_width_gives_nothing(spark):
    scaled = resample.file_thumbnails(image(spark, 1, 2000), dims(spark, (1, 2000)))
    assert scaled.count() == 0


@pytest.mark.parametrize("width, height, size", [(1920, 1080, 333), (50, 80, 2048), (301, 300, 300)])
def test_fit(spark, width, height, size):
    scaled = resample.resample(image(spark, width, height),
                               resample.preview_dims(dims(spark, (width, height)), size))
    scale = min(np.float32(size) / np.float32(max(width, height)), np.float32(1))
    assert cells(scaled) == expected(width, height, scale)


def test_4096_columns(spark):
    """The column arithmetic of a 4096 x 2160 image, on one of its rows."""
    row = image(spark, 4096, 1)
    target = resample.thumb_dims(dims(spark, (4096, 2160)), 150)
    got = {x: g for (y, x), (_, g) in cells(resample.resample(row, target)).items() if y == 0}
    assert got == {x: int(s) for x, s in enumerate(
        sources(284, np.float32(150) / np.float32(2160), 4096))}


def test_auto_takes_only_big_images(spark):
    both = image(spark, 40, 30, 1).unionByName(image(spark, 20, 10, 2))
    scaled = resample.resample(both, resample.auto_dims(dims(spark, (40, 30), (20, 10)), 16, 1000))
    assert cells(scaled.filter("image_id = 1")) == expected(40, 30, np.float32(16) / np.float32(40))
    assert cells(scaled.filter("image_id = 2")) == expected(20, 10, 1.0)


def test_pixels_are_not_shuffled(spark):
    two = spark.range(800).selectExpr(
        "id % 2 + 1 image_id", "cast(id div 40 as int) y", "cast(id div 2 % 20 as int) x",
        "cast(1 as float) r", "cast(1 as float) g", "cast(1 as float) b", "cast(1 as float) a")
    scaled = resample.preview_thumbnails(two, dims(spark, (20, 20), (20, 20)), 16)
    plan = scaled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert scaled.count() == 2 * 16 * 16


def test_images_without_a_size_are_listed(spark):
    pixels = spark.createDataFrame([(i, 0, x, .5, .5, .5, 1.) for i in (1, 2, 3) for x in (0, 1)],
                                   "image_id long, y int, x int, r float, g float, b float, a float")
    dims = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "image_id long, width int, height int")
    assert sorted(map(tuple, resample.unsized_images(pixels, dims).collect())) == [(2, 2), (3, 2)]
    assert [(r["image_id"], r["x"]) for r in resample.pixels_outside(pixels, dims).collect()] == [(1, 1)]
    for job in (resample.file_thumbnails, resample.preview_thumbnails, resample.preview_auto):
        assert {r["image_id"] for r in job(pixels, dims).collect()} == {1}

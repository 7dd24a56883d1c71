"""Pixel arithmetic against a plain single-precision reading of the rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.functions import color
from lumigrid.operators import pixels


def expected(values, exposure, gamma, reference=True):
    v = np.asarray(values, np.float64)
    v = np.where(np.isfinite(v), np.maximum(v, 0), 0) * 2.0 ** exposure
    t = np.clip(v * (2.51 * v + 0.03) / (v * (2.43 * v + 0.59) + 0.14), 0, 1)
    inverse = 1 / max(gamma, 1e-4)
    if reference and abs(inverse - 0.45454545) < 0.001:
        t = t ** 0.75
    else:
        t = t ** inverse
    return np.floor(t * 255 + 0.5).astype(int).tolist()


VALUES = [0.0, -0.5, 0.001, 0.18, 0.5, 1.0, 2.5, 100.0, 1e30, math.nan, math.inf, -math.inf]


def pixel_table(spark, values):
    return spark.createDataFrame([(i, v, v, v, v) for i, v in enumerate(values)],
                                 "i INT, r FLOAT, g FLOAT, b FLOAT, a FLOAT")


@pytest.mark.parametrize("gamma", [2.0, 2.19, 2.2, 2.21, 1.0, 0.5, 4.5, 0.0])
@pytest.mark.parametrize("exposure", [-5.0, 0.0, 1.3])
def test_tone_map(spark, gamma, exposure):
    single = np.float32(VALUES)
    rows = pixels.tone_map(pixel_table(spark, VALUES), exposure, gamma).orderBy("i").collect()
    want = expected(single, exposure, gamma)
    assert [r.r8 for r in rows] == want
    assert [r.g8 for r in rows] == want
    by_column = pixels.tone_map(
        pixel_table(spark, VALUES).withColumns({"ev": F.lit(exposure), "ga": F.lit(gamma)}),
        F.col("ev"), F.col("ga")).orderBy("i").collect()
    assert [r.b8 for r in by_column] == want


def test_alpha(spark):
    rows = pixels.tone_map(pixel_table(spark, VALUES), 3.0, 2.0).orderBy("i").collect()
    assert [r.a8 for r in rows] == [0, 0, 0, 46, 128, 255, 255, 255, 255, 255, 255, 255]


def test_gamma_22_shortcut(spark):
    t = spark.range(1).select(*[color.quantize8(color.gamma_encode(F.lit(0.18), g))
                                for g in (2.2, 2.19, 2.21)],
                              color.quantize8(color.gamma_encode(F.lit(0.18), 2.2, "exact"))).first()
    assert tuple(t) == (70, 117, 117, 117)


def test_monotone_in_exposure(spark):
    table = pixel_table(spark, [0.01 * i for i in range(100)])
    previous = [-1] * 100
    for ev in (-5, -2, 0, 2, 5):
        now = [r.r8 for r in pixels.tone_map(table, float(ev), 2.2).orderBy("i").collect()]
        assert all(a <= b for a, b in zip(previous, now)) and 0 <= min(now) <= max(now) <= 255
        previous = now


def test_gray_is_the_maximum(spark):
    table = spark.createDataFrame([(0.1, 0.9, 0.5, 0.5)], "r FLOAT, g FLOAT, b FLOAT, a FLOAT")
    colour = pixels.tone_map(table, 0.0, 1.0).first()
    gray = pixels.composite(table, 0.0, 1.0, lighting_rgb=False).first()
    assert gray.r8 == gray.g8 == gray.b8 == colour.g8 and gray.a8 == colour.a8 == 128


def test_no_python_and_no_shuffle(spark):
    plan = pixels.tone_map(pixel_table(spark, VALUES), 1.0, 2.2)._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1] and "Python" not in plan


def test_nan_stays_nan_and_is_black(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (-1.0,)], "v double")
    rows = df.select(color.clamp01(F.col("v")), color.quantize8(F.col("v"))).collect()
    assert math.isnan(rows[0][0]) and [r[0] for r in rows[1:]] == [1.0, 0.0]
    assert [r[1] for r in rows] == [0, 255, 0]

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumigrid.operators.depth import depth_bounds, normalize_depth
from lumigrid import scale
from lumigrid.scale import order_statistics, ordered_bits, value_bucket


def expected(values, invert):
    """Sort, take two positions, map."""
    v = np.float32(values).astype(np.float64)
    n = len(v)
    s = np.sort(v)  # NaN last
    lo, hi = s[n // 100], s[max((99 * n + 99) // 100 - 1, 0)]
    if not (np.isfinite(lo) and np.isfinite(hi)) or abs(hi - lo) < 1e-20:
        safe = np.where(np.isfinite(v), v, 0)
        lo, hi = safe.min(), safe.max()
    if abs(hi - lo) < 1e-12:
        hi = lo + 1
    with np.errstate(invalid="ignore"):
        t = np.clip((v - lo) / (hi - lo), 0, 1)
    t = 1 - t if invert else t
    return [0 if np.isnan(x) else int(math.floor(y * 255 + 0.5)) for x, y in zip(v, t)]


def run(spark, values, invert):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)],
                               "image_id BIGINT, i INT, r FLOAT")
    return [r.r8 for r in normalize_depth(df, invert).orderBy("i").collect()]


RNG = np.random.default_rng(7)
CASES = {
    "equal": [3.0] * 10, "one": [5.0], "n99": RNG.lognormal(size=99), "n100": RNG.lognormal(size=100),
    "n101": RNG.lognormal(size=101), "n1000": RNG.normal(size=1000) * 1e6,
    "nan": [*RNG.normal(size=150), math.nan], "nans": [1.0, math.nan, math.nan, 2.0],
    "inf": [1.0, 2.0, math.inf], "minus_inf": [-math.inf, 1.0, 2.0], "only_nan": [math.nan] * 3,
    "tiny": [1e-30, 2e-30, 3e-30], "signs": [-1.0, 0.0, -0.0, 1e-40, -1e-40, 1.0],
    "flat_percentiles": [*[1.0] * 300, 9.0],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("invert", [True, False])
def test_against_sorting(spark, name, invert):
    assert run(spark, CASES[name], invert) == expected(CASES[name], invert)


def test_empty(spark):
    empty = spark.createDataFrame([], "image_id BIGINT, r FLOAT")
    assert normalize_depth(empty).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(width=32, allow_nan=False), min_size=1, max_size=40),
                min_size=1, max_size=5))
def test_order_statistics(spark, groups):
    rows = [(g, v) for g, values in enumerate(groups) for v in values]
    df = spark.createDataFrame(rows, "g INT, v FLOAT")
    n = F.col("n")
    got = {r.g: (r.n, r.low, r.mid, r.high) for r in order_statistics(
        df, ["g"], "v", {"low": n * 0, "mid": F.floor(n / 2), "high": n - 1}).collect()}
    for g, values in enumerate(groups):
        s = sorted(np.float32(values).tolist())
        assert got[g] == (len(s), s[0], s[len(s) // 2], s[-1])


def test_buckets_follow_the_values(spark):
    values = sorted([*RNG.normal(size=500), *(RNG.normal(size=500) * 1e30), *(RNG.normal(size=300) * 1e-30),
                     0.0, 1.0, 2.0, 4.0, math.inf, -math.inf])
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE")
    buckets = [r[0] for r in df.orderBy("v").select(value_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets)


def test_hot_image_is_not_sorted_raw(spark):
    df = spark.range(100000).select(F.lit(1).cast("bigint").alias("image_id"),
                                    (F.col("id") % 500).cast("float").alias("r"))
    row = depth_bounds(df).first()
    assert (row.lo, row.hi) == (5.0, 494.0)


def test_null_is_no_value(spark):
    rows = [(1, v) for v in (None, None, 5.0, 9.0)] + [(2, None)]
    df = spark.createDataFrame(rows, "image_id long, r double")
    bounds = {b["image_id"]: (b["lo"], b["hi"]) for b in depth_bounds(df).collect()}
    assert bounds == {1: (5.0, 9.0)}
    got = sorted(((p["image_id"], p["r8"]) for p in normalize_depth(df, invert=False).collect()), key=str)
    assert got == sorted([(1, None), (1, None), (1, 0), (1, 255), (2, None)], key=str)


def test_bits_keep_the_order(spark):
    values = sorted({*RNG.normal(size=300), *(RNG.normal(size=300) * 1e300), *(RNG.normal(size=300) * 1e-310), 0.0,
                     *[s * math.nextafter(2.0 ** e, b) for e in range(-1074, 1023, 31) for s in (1, -1) for b in (-9, math.inf)],
                     *[s * 2.0 ** e for e in range(-1074, 1024, 31) for s in (1, -1)], math.inf, -math.inf})
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([*values, math.nan])], "i INT, v DOUBLE")
    bits = [r[0] for r in df.orderBy("i").select(ordered_bits(F.col("v"))).collect()]
    assert bits == sorted(set(bits)) and len(bits) == len(values) + 1
    own = lambda v: np.float64(abs(v)).view(np.int64) * (1 if v >= 0 else -1)
    assert bits[:-1] == [own(v) for v in values]


@pytest.mark.parametrize("kind", ["DOUBLE", "BIGINT", "INT", "FLOAT"])
def test_a_million_values_of_one_bucket(spark, kind):
    """All values lie in one coarse bucket; the windows over counts stay small."""
    n, base = 1_000_000, {"DOUBLE": 1.0, "FLOAT": 1.0, "BIGINT": 1 << 60, "INT": 1 << 30}[kind]
    step = {"DOUBLE": 2.0 ** -31, "FLOAT": 2.0 ** -23, "BIGINT": 977, "INT": 3}[kind]
    values = n if kind != "FLOAT" else 1 << 14
    value = F.lit(base).cast(kind) + (F.pmod(F.col("id") * 7919, F.lit(values)) * step).cast(kind)
    df = spark.range(n).select(F.lit(1).alias("g"), value.cast(kind).alias("v"))
    assert df.select(value_bucket(F.col("v"))).distinct().count() <= 2
    n_ = F.col("n")
    got = order_statistics(df, ["g"], "v", {"low": n_ * 0, "a": F.floor(n_ / 3), "b": F.floor(n_ / 3) + 1, "high": n_ - 1}).first()
    want = np.sort(base + (np.arange(n, dtype=np.int64) * 7919 % values) * (step if kind != "BIGINT" else np.int64(step)))
    assert [got.n, got.low, got.a, got.b, got.high] == [n, want[0], want[n // 3], want[n // 3 + 1], want[-1]]


def test_cells_are_bounded(spark):
    """A cell has at most some 2**16 next ones, at every step and for every kind of value."""
    for kind, values in [("double", [1.0, 1.0 + 2.0 ** -9, 1e-310, 1e-310 * (1 + 2.0 ** -9)]), ("bigint", [1 << 62, (1 << 62) + (1 << 53)]),
                         ("int", [1 << 30, (1 << 30) + (1 << 21)])]:
        df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
        cells = [value_bucket(F.col("v")), *scale._fine_cells(kind, F.col("v"))]
        rows = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(cells)]).collect()
        for a, b in zip(rows[::2], rows[1::2], strict=True):
            assert abs(b[1] - a[1]) <= 1 << 16
    with pytest.raises(TypeError):
        scale._fine_cells("string", F.col("v"))

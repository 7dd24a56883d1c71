"""Percentile normalisation of depth images."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.functions import color
from lumigrid.scale import materialize, order_statistics

# Degenerate ranges.
FLAT_PERCENTILES = 1e-20
FLAT_RANGE = 1e-12


IMAGE = ("image_id",)


def depth_bounds(pixels: DataFrame, value: str = "r", image: Sequence[str] = IMAGE) -> DataFrame:
    """One row per image: ``lo`` and ``hi`` of the linear depth map.

    Index rule ``floor(n/100)`` and ``ceil(99n/100) - 1`` in integers.  Where these two values are
    not finite or coincide, the minimum and maximum with non-finite values read as 0 are used.
    """
    n = F.col("n")
    safe = color.finite_or(F.col(value), 0.0)
    stats = order_statistics(
        pixels, image, value,
        {"p01": F.floor(n / 100), "p99": F.greatest(F.floor((n * 99 + 99) / 100) - 1, F.lit(0))},
        minima={"lowest": safe}, maxima={"highest": safe})
    p01, p99 = F.col("p01").cast("double"), F.col("p99").cast("double")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < math.inf)
    usable = finite(p01) & finite(p99) & (F.abs(p99 - p01) >= FLAT_PERCENTILES)
    lo = F.when(usable, p01).otherwise(F.col("lowest"))
    hi = F.when(usable, p99).otherwise(F.col("highest"))
    return (stats.select(*image, lo.alias("lo"), hi.alias("_hi"))
            .select(*image, "lo",
                    F.when(F.abs(F.col("_hi") - F.col("lo")) < FLAT_RANGE, F.col("lo") + 1.0)
                    .otherwise(F.col("_hi")).alias("hi")))


def normalize_depth(pixels: DataFrame, invert: bool = True, value: str = "r",
                    image: Sequence[str] = IMAGE) -> DataFrame:
    """Per image, the 1 % to 99 % range of ``value`` to gray 0..255, alpha 255.

    The bounds (one row per image) are written out first, so the second scan of the pixels joins a
    table of known size: broadcast when small, and then no pixel is shuffled.
    """
    bounds = materialize(depth_bounds(pixels, value, image))
    g8 = color.depth_map(F.col(value), F.col("lo"), F.col("hi"), invert)
    scene = [c for c in ("r", "g", "b", "a", value) if c in pixels.columns]
    # An image of nothing but NULL has no bounds; its pixels stay, and are NULL.
    return (pixels.join(bounds, list(image), "left")
            .withColumns({"r8": g8, "a8": F.lit(255)})
            .withColumns({"g8": F.col("r8"), "b8": F.col("r8")})
            .drop("lo", "hi", *scene))

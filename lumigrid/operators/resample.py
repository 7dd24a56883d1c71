"""Nearest-neighbour thumbnails and previews.

Instead of building a grid of target pixels and joining it to the source (which would shuffle every
pixel of the archive), each source pixel computes which target pixels read it, usually none when
shrinking.  Only the image sizes are joined, so the job is one scan and a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.functions import color, grid
from lumigrid.operators.pixels import tone_map
from lumigrid.scale import materialize

# Sizes used by the gallery and the interactive preview.
THUMB_HEIGHT = 150
PREVIEW_SIZE = 2048
PREVIEW_ABOVE_PIXELS = 2_000_000


def scaled_dims(dims: DataFrame, scale: Column, fixed_height: int | None = None) -> DataFrame:
    """Add ``scale``, ``t_width``, ``t_height`` to the image sizes."""
    w, h, s = F.col("width"), F.col("height"), F.col("scale")
    t_height = F.lit(fixed_height) if fixed_height else F.floor(grid.f32_mul(h, s)).cast("int")
    return (dims.withColumn("scale", scale)
            .withColumns({"t_width": F.floor(grid.f32_mul(w, s)).cast("int"),
                          "t_height": t_height}))


def thumb_dims(dims: DataFrame, thumb_height: int = THUMB_HEIGHT) -> DataFrame:
    """Sizes at a fixed height, enlarging too."""
    return scaled_dims(dims, grid.f32_div(F.lit(thumb_height), F.col("height")), thumb_height)


def _fit_scale(max_size: int) -> Column:
    longer = F.greatest("width", "height")
    return F.least(grid.f32_div(F.lit(max_size), longer), F.lit(1.0))


def preview_dims(dims: DataFrame, max_size: int = PREVIEW_SIZE) -> DataFrame:
    """Sizes with the longer side at most ``max_size``, never enlarging."""
    return scaled_dims(dims, _fit_scale(max_size))


def auto_dims(dims: DataFrame, max_size: int = PREVIEW_SIZE,
              above: int = PREVIEW_ABOVE_PIXELS) -> DataFrame:
    """As ``preview_dims`` for images of more than ``above`` pixels; others keep their size."""
    many = F.col("width").cast("bigint") * F.col("height") > above
    return scaled_dims(dims, F.when(many, _fit_scale(max_size)).otherwise(F.lit(1.0)))


def sized(dims: DataFrame) -> DataFrame:
    """Image sizes that can be scaled."""
    return dims.filter((F.col("width") > 0) & (F.col("height") > 0))


def unsized_images(pixels: DataFrame, dims: DataFrame) -> DataFrame:
    """Images that have pixels but no size above zero, with their number of pixels; they give no
    thumbnail.  Pixels are counted on the map side, so none is shuffled."""
    counted = pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pixels"))
    return counted.join(sized(dims).select("image_id"), "image_id", "left_anti")


def pixels_outside(pixels: DataFrame, dims: DataFrame) -> DataFrame:
    """Pixels beyond the size of their image; no thumbnail reads them."""
    x, y = F.col("x"), F.col("y")
    within = (x >= 0) & (x < F.col("width")) & (y >= 0) & (y < F.col("height"))
    return (pixels.join(materialize(sized(dims).select("image_id", "width", "height")), "image_id")
            .filter(~within).drop("width", "height"))


def resample(pixels: DataFrame, target: DataFrame) -> DataFrame:
    """Nearest-neighbour pixels at the sizes of ``target`` (as made by ``*_dims``).

    ``unsized_images`` and ``pixels_outside`` list what has no place in the result.
    """
    sizes = materialize(sized(target).select("image_id", "width", "height", "scale", "t_width",
                                             "t_height"))
    scale = F.col("scale")
    top, bottom = grid.target_range(F.col("y"), scale, F.col("height"), F.col("t_height"))
    left, right = grid.target_range(F.col("x"), scale, F.col("width"), F.col("t_width"))
    kept = [c for c in pixels.columns if c not in ("x", "y")]
    return (pixels.join(sizes, "image_id")
            .filter(top <= bottom).filter(left <= right)
            .withColumn("_y", F.explode(F.sequence(top, bottom)))
            .withColumn("_x", F.explode(F.sequence(left, right)))
            .select(*kept, F.col("_y").alias("y"), F.col("_x").alias("x")))


def file_thumbnails(pixels: DataFrame, dims: DataFrame, thumb_height: int = THUMB_HEIGHT,
                    exposure: color.Number = color.DEFAULT_EXPOSURE,
                    gamma: color.Number = color.DEFAULT_GAMMA) -> DataFrame:
    """Every image at one height, tone mapped.  Images of zero target width give no rows."""
    return tone_map(resample(pixels, thumb_dims(dims, thumb_height)), exposure, gamma)


def preview_thumbnails(pixels: DataFrame, dims: DataFrame, max_size: int = PREVIEW_SIZE,
                       exposure: color.Number = color.DEFAULT_EXPOSURE,
                       gamma: color.Number = color.DEFAULT_GAMMA) -> DataFrame:
    """Every image fitted into ``max_size``, tone mapped."""
    return tone_map(resample(pixels, preview_dims(dims, max_size)), exposure, gamma)


def preview_auto(pixels: DataFrame, dims: DataFrame, max_size: int = PREVIEW_SIZE,
                 above: int = PREVIEW_ABOVE_PIXELS,
                 exposure: color.Number = color.DEFAULT_EXPOSURE,
                 gamma: color.Number = color.DEFAULT_GAMMA) -> DataFrame:
    """J11 for big images, J07 for the others.

    Scale 1 is the identity of the resampler, so both cases are one scan rather than a union of two.
    """
    return tone_map(resample(pixels, auto_dims(dims, max_size, above)), exposure, gamma)

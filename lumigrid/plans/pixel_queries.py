"""Checked queries on pixels: expressions E10-E16, E25, E26, jobs J07-J12, variants D1-D5."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumigrid.functions import color, grid
from lumigrid.operators import depth, pixels, resample
from lumigrid.plans.oracle_fixtures import alpha, colour, curve, gamma, q8, rgba8, with_ctes
from lumigrid.plans.registry import checked
from lumigrid.sources import fixtures

AT = "image_id, y, x"
# Spreads the values of the LDR test images over the 8-bit range.
EV = 3.0


def _ldr(sql: str) -> str:
    return with_ctes(f"SELECT {AT}, {sql} FROM pixels")


def _hdr(sql: str) -> str:
    return with_ctes(f"SELECT image_id, {sql} FROM hdr")


# Expressions -------------------------------------------------------------------------------------

# Three columns of every eight are given values that are not finite.
@checked("E10_finite_or", _ldr("CASE WHEN x % 8 IN (0, 3, 5) THEN 0::DOUBLE ELSE r::DOUBLE END AS safe_r, "
                               "CASE WHEN x % 8 IN (0, 3, 5) THEN 1::DOUBLE ELSE a::DOUBLE END AS safe_a"))
def _(spark, sf):
    odd = lambda c: (F.when(F.col("x") % 8 == 0, float("nan")).when(F.col("x") % 8 == 3, float("inf"))
                     .when(F.col("x") % 8 == 5, float("-inf")).otherwise(F.col(c)))
    return fixtures.pixels(spark, sf).select(
        "image_id", "y", "x", color.finite_or(odd("r"), 0.0).alias("safe_r"),
        color.finite_or(odd("a"), 1.0).alias("safe_a"))


@checked("E11_expose", _ldr("r::DOUBLE * 8 AS exposed"))
def _(spark, sf):
    return fixtures.pixels(spark, sf).select(
        "image_id", "y", "x", color.expose(F.col("r").cast("double"), EV).alias("exposed"))


@checked("E12_aces", _hdr(f"{curve('r::DOUBLE')} AS curve"))
def _(spark, sf):
    return fixtures.hdr_pixels(spark, sf).select(
        "image_id", color.aces(F.col("r").cast("double")).alias("curve"))


@checked("E13_gamma_encode", _hdr(", ".join(
    f"{gamma('(1 - b::DOUBLE / 2)', g)} AS g{i}" for i, g in enumerate([2.2, 2.0, 1.0, 2.19]))))
def _(spark, sf):
    t = 1.0 - F.col("b").cast("double") / 2
    return fixtures.hdr_pixels(spark, sf).select(
        "image_id", *[color.gamma_encode(t, g).alias(f"g{i}")
                      for i, g in enumerate([2.2, 2.0, 1.0, 2.19])])


@checked("E14_quantize8", _ldr(f"{q8(alpha('r'))} AS q"))
def _(spark, sf):
    return fixtures.pixels(spark, sf).select(
        "image_id", "y", "x", color.quantize8(F.col("r").cast("double")).alias("q"))


@checked("E15_gray_max", with_ctes(
    f"SELECT {AT}, greatest(r8, g8, b8) AS gray FROM (SELECT {AT}, {rgba8(EV, 2.2)} FROM pixels)"))
def _(spark, sf):
    mapped = pixels.tone_map(fixtures.pixels(spark, sf), EV, 2.2)
    return mapped.select("image_id", "y", "x", color.gray_max(
        F.col("r8"), F.col("g8"), F.col("b8")).alias("gray"))


def _mapped(v: str, lo: str, hi: str, invert: bool) -> str:
    t = alpha(f"(({v})::DOUBLE - {lo}) / ({hi} - {lo})")
    return q8(f"(1 - {t})" if invert else t)


@checked("E16_depth_map", _hdr(f"{_mapped('depth', '1000::DOUBLE', '90000::DOUBLE', False)} AS far, "
                               f"{_mapped('depth', '1000::DOUBLE', '90000::DOUBLE', True)} AS near"))
def _(spark, sf):
    lo, hi = F.lit(1000.0), F.lit(90000.0)
    return fixtures.hdr_pixels(spark, sf).select(
        "image_id", color.depth_map(F.col("depth"), lo, hi, False).alias("far"),
        color.depth_map(F.col("depth"), lo, hi, True).alias("near"))


@checked("E25_pixel_index", with_ctes(
    f"SELECT {AT}, idx, cast(idx % 16 AS INTEGER) AS back_x, cast(idx // 16 AS INTEGER) AS back_y "
    f"FROM (SELECT {AT}, y::BIGINT * 16 + x AS idx FROM pixels)"))
def _(spark, sf):
    width = F.lit(fixtures.WIDTH)
    indexed = fixtures.pixels(spark, sf).select(
        "image_id", "y", "x", grid.pixel_index(F.col("x"), F.col("y"), width).alias("idx"))
    back_x, back_y = grid.pixel_xy(F.col("idx"), width)
    return indexed.withColumns({"back_x": back_x, "back_y": back_y})


@checked("E26_clamp01", with_ctes(
    f"SELECT session, event_id, CASE WHEN event_id % 23 = 0 THEN -9::DOUBLE ELSE {alpha('p * 1.5 - 0.1')} END "
    "AS progress FROM prog"))
def _(spark, sf):
    """NaN stays NaN; it is written as -9 here."""
    return fixtures.progress_updates(spark, sf).select("session", "event_id", F.nanvl(
        color.clamp01(F.col("p") * 1.5 - 0.1), F.lit(-9.0)).alias("progress"))


# Tone mapping ------------------------------------------------------------------------------------

@checked("J07_tone_map", _ldr(rgba8(EV, 2.2)))
def tone_map_ldr(spark, sf):
    return pixels.tone_map(fixtures.pixels(spark, sf), EV, 2.2)


@checked("J07_tone_map_hdr", _hdr(rgba8(-2.0, 2.19)))
def tone_map_hdr(spark, sf):
    return pixels.tone_map(fixtures.hdr_pixels(spark, sf).drop("depth"), -2.0, 2.19)


@checked("J08_composite_gray", with_ctes(
    f"SELECT {AT}, greatest(r8, g8, b8) AS r8, greatest(r8, g8, b8) AS g8, "
    f"greatest(r8, g8, b8) AS b8, a8 FROM (SELECT {AT}, {rgba8(EV, 2.0)} FROM pixels)"))
def _(spark, sf):
    return pixels.composite(fixtures.pixels(spark, sf), EV, 2.0, lighting_rgb=False)


@checked("J08_composite_rgb", _hdr(rgba8(-1.0, 1.0)))
def _(spark, sf):
    return pixels.composite(fixtures.hdr_pixels(spark, sf).drop("depth"), -1.0, 1.0, True)


@checked("D1_reinhard", _hdr(rgba8(0.0, 2.2, "reinhard")))
def _(spark, sf):
    return pixels.tone_map(fixtures.hdr_pixels(spark, sf).drop("depth"), 0.0, 2.2, "reinhard")


@checked("D2_clamp_curve", _hdr(rgba8(-3.0, 2.2, "clamp")))
def _(spark, sf):
    return pixels.tone_map(fixtures.hdr_pixels(spark, sf).drop("depth"), -3.0, 2.2, "clamp")


@checked("D3_exact_gamma", _ldr(rgba8(EV, 2.2, mode="exact")))
def _(spark, sf):
    return pixels.tone_map(fixtures.pixels(spark, sf), EV, 2.2, gamma_mode="exact")


@checked("D4_quantize16", _ldr(rgba8(EV, 2.2, levels=65535, suffix="16")))
def _(spark, sf):
    return pixels.tone_map16(fixtures.pixels(spark, sf), EV, 2.2)


def _dithered(c: str) -> str:
    inner = "(x::DOUBLE * 0.06711056::DOUBLE + y::DOUBLE * 0.00583715::DOUBLE)"
    inner = f"(({inner} - floor({inner})) * 52.9829189::DOUBLE)"
    noise = f"({inner} - floor({inner}))"
    return (f"least(cast(floor({alpha(colour(c, EV, 2.2))} * 255 + {noise}) AS INTEGER), 255) "
            f"AS {c}8")


@checked("D5_dithering", _ldr(", ".join([*map(_dithered, "rgb"), f"{q8(alpha('a'))} AS a8"])))
def _(spark, sf):
    return pixels.tone_map_dithered(fixtures.pixels(spark, sf), EV, 2.2)


# Depth -------------------------------------------------------------------------------------------

def _depth_sql(source: str, value: str, at: str, invert: bool) -> str:
    g8 = _mapped(f"p.{value}", "lo", "hi", invert)
    return with_ctes(
        f"SELECT {at}, {g8} AS r8, {g8} AS g8, {g8} AS b8, 255 AS a8 FROM {source} p JOIN wide USING "
        "(image_id)", {
            "ordered": f"SELECT image_id, {value}::DOUBLE AS v, row_number() OVER (PARTITION BY "
                       f"image_id ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY image_id) "
                       f"AS n FROM {source}",
            "ends": "SELECT image_id, max(CASE WHEN i = n // 100 THEN v END) AS p01, max(CASE WHEN "
                    "i = greatest((99 * n + 99) // 100 - 1, 0) THEN v END) AS p99, min(v) AS lowest, "
                    "max(v) AS highest FROM ordered GROUP BY image_id",
            "chosen": "SELECT image_id, CASE WHEN abs(p99 - p01) >= 1e-20 THEN p01 ELSE lowest END "
                      "AS lo, CASE WHEN abs(p99 - p01) >= 1e-20 THEN p99 ELSE highest END AS h "
                      "FROM ends",
            "wide": "SELECT image_id, lo, CASE WHEN abs(h - lo) < 1e-12 THEN lo + 1 ELSE h END AS hi "
                    "FROM chosen"})


@checked("J09_normalize_depth", _depth_sql("hdr", "depth", "image_id", True))
def normalize_depth_hdr(spark, sf):
    return depth.normalize_depth(
        fixtures.hdr_pixels(spark, sf).select("image_id", "depth"), True, "depth")


@checked("J09_normalize_depth_ldr", _depth_sql("pixels", "r", AT, False))
def _(spark, sf):
    return depth.normalize_depth(fixtures.pixels(spark, sf), invert=False)


# Resampling --------------------------------------------------------------------------------------

def _resampled_sql(scale: str, t_height: str, ev: float, g: float) -> str:
    return with_ctes(
        f"SELECT t.image_id, t.y, t.x, {rgba8(ev, g)} FROM grid t JOIN pixels p ON "
        "p.image_id = t.image_id AND p.y = least(cast(floor((t.y::FLOAT / t.scale)::FLOAT) AS "
        "INTEGER), t.height - 1) AND p.x = least(cast(floor((t.x::FLOAT / t.scale)::FLOAT) AS "
        "INTEGER), t.width - 1)", {
            "scaled": f"SELECT *, ({scale})::FLOAT AS scale FROM dims",
            "sized": "SELECT *, cast(floor((width::FLOAT * scale)::FLOAT) AS INTEGER) AS tw, "
                     f"cast({t_height} AS INTEGER) AS th FROM scaled",
            "rowgrid": "SELECT *, cast(unnest(range(th)) AS INTEGER) AS y FROM sized",
            "grid": "SELECT *, cast(unnest(range(tw)) AS INTEGER) AS x FROM rowgrid"})


# Image 1 has no size, image 2 a height of zero, and image 3 is declared smaller than it is.
def _odd_dims(spark, sf):
    image, height = F.col("image_id"), F.col("height")
    return fixtures.dims(spark, sf).filter(image != 1).select(
        "image_id", F.when(image == 3, 12).otherwise(F.col("width")).alias("width"),
        F.when(image == 2, 0).when(image == 3, height - 2).otherwise(height).alias("height"))


@checked("J10_unsized_images", with_ctes(
    "SELECT image_id, count(*) AS n_pixels FROM pixels WHERE image_id IN (1, 2) GROUP BY image_id"))
def _(spark, sf):
    return resample.unsized_images(fixtures.pixels(spark, sf), _odd_dims(spark, sf))


@checked("J10_pixels_outside", with_ctes(
    "SELECT p.* FROM pixels p JOIN dims d USING (image_id) WHERE image_id = 3 AND (x >= 12 OR y >= height - 2)"))
def _(spark, sf):
    return resample.pixels_outside(fixtures.pixels(spark, sf), _odd_dims(spark, sf))


@checked("J10_file_thumbnails_odd_sizes", _resampled_sql("31::FLOAT / height::FLOAT", "31", EV, 2.2).replace(
    "FROM dims", "FROM (SELECT image_id, CASE WHEN image_id = 3 THEN 12 ELSE width END AS width, "
    "CASE WHEN image_id = 3 THEN height - 2 ELSE height END AS height FROM dims WHERE image_id NOT IN (1, 2))"))
def _(spark, sf):
    return resample.file_thumbnails(fixtures.pixels(spark, sf), _odd_dims(spark, sf), 31, EV, 2.2)


def _fit(size: int) -> str:
    return f"least({size}::FLOAT / greatest(width, height)::FLOAT, 1::FLOAT)"


_SCALED_HEIGHT = "floor((height::FLOAT * scale)::FLOAT)"


@checked("J10_file_thumbnails", _resampled_sql("150::FLOAT / height::FLOAT", "150", EV, 2.2))
def file_thumbnails_150(spark, sf):
    return resample.file_thumbnails(fixtures.pixels(spark, sf), fixtures.dims(spark, sf),
                                    resample.THUMB_HEIGHT, EV, 2.2)


@checked("J10_file_thumbnails_shrunk",
         _resampled_sql("31::FLOAT / height::FLOAT", "31", EV, 2.2))
def _(spark, sf):
    return resample.file_thumbnails(fixtures.pixels(spark, sf), fixtures.dims(spark, sf),
                                    31, EV, 2.2)


@checked("J11_preview_thumbnails", _resampled_sql(_fit(2048), _SCALED_HEIGHT, EV, 2.2))
def _(spark, sf):
    return resample.preview_thumbnails(fixtures.pixels(spark, sf), fixtures.dims(spark, sf),
                                       resample.PREVIEW_SIZE, EV, 2.2)


@checked("J11_preview_thumbnails_small", _resampled_sql(_fit(37), _SCALED_HEIGHT, EV, 2.2))
def _(spark, sf):
    return resample.preview_thumbnails(fixtures.pixels(spark, sf), fixtures.dims(spark, sf),
                                       37, EV, 2.2)


def _auto(size: int, above: int) -> str:
    return f"CASE WHEN width * height > {above} THEN {_fit(size)} ELSE 1::FLOAT END"


@checked("J12_preview_auto",
         _resampled_sql(_auto(2048, 2_000_000), _SCALED_HEIGHT, EV, 2.2))
def _(spark, sf):
    return resample.preview_auto(fixtures.pixels(spark, sf), fixtures.dims(spark, sf),
                                 exposure=EV, gamma=2.2)


@checked("J12_preview_auto_mixed", _resampled_sql(_auto(37, 800), _SCALED_HEIGHT, EV, 2.2))
def _(spark, sf):
    return resample.preview_auto(fixtures.pixels(spark, sf), fixtures.dims(spark, sf),
                                 37, 800, EV, 2.2)

"""Per-pixel jobs.  All are narrow: one scan, generated code, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.functions import color

COLOUR = ("r", "g", "b")
SCENE = (*COLOUR, "a")


def _encoded(exposure, gamma, curve, gamma_mode):
    out = {f"{c}8": color.quantize8(
        color.encode_colour(F.col(c), exposure, gamma, curve, gamma_mode)) for c in COLOUR}
    out["a8"] = color.quantize8(color.encode_alpha(F.col("a")))
    return out


def tone_map(pixels: DataFrame, exposure: color.Number = color.DEFAULT_EXPOSURE,
             gamma: color.Number = color.DEFAULT_GAMMA, curve: str = "aces",
             gamma_mode: str = "reference") -> DataFrame:
    """Scene r, g, b, a to 8-bit r8, g8, b8, a8; other columns are kept.

    ``exposure`` and ``gamma`` are numbers or columns.  Numbers fold at plan time.
    """
    return pixels.withColumns(_encoded(exposure, gamma, curve, gamma_mode)).drop(*SCENE)


def composite(pixels: DataFrame, exposure: color.Number = color.DEFAULT_EXPOSURE,
              gamma: color.Number = color.DEFAULT_GAMMA, lighting_rgb: bool = True) -> DataFrame:
    """Colour as J07, or gray as the largest of the three 8-bit channels."""
    mapped = tone_map(pixels, exposure, gamma)
    if lighting_rgb:
        return mapped
    gray = color.gray_max(F.col("r8"), F.col("g8"), F.col("b8"))
    return mapped.withColumns({"r8": gray, "g8": gray, "b8": gray})


def tone_map16(pixels: DataFrame, exposure: color.Number = color.DEFAULT_EXPOSURE,
               gamma: color.Number = color.DEFAULT_GAMMA) -> DataFrame:
    """As J07 with 16 bits per channel."""
    out = {f"{c}16": color.quantize16(color.encode_colour(F.col(c), exposure, gamma))
           for c in COLOUR}
    out["a16"] = color.quantize16(color.encode_alpha(F.col("a")))
    return pixels.withColumns(out).drop(*SCENE)


def tone_map_dithered(pixels: DataFrame, exposure: color.Number = color.DEFAULT_EXPOSURE,
                      gamma: color.Number = color.DEFAULT_GAMMA) -> DataFrame:
    """As J07, colours dithered by position before quantisation.  Repeatable."""
    x, y = F.col("x"), F.col("y")
    out = {f"{c}8": color.quantize8_dithered(
        color.encode_colour(F.col(c), exposure, gamma), x, y) for c in COLOUR}
    out["a8"] = color.quantize8(color.encode_alpha(F.col("a")))
    return pixels.withColumns(out).drop(*SCENE)

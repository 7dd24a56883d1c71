"""Pixel coordinates and the single-precision scaling arithmetic of the resampler.

The scale is a 32-bit float and so is every product and quotient with it; 64-bit arithmetic would
pick other source pixels.  A quotient or product of two 32-bit floats, computed in 64 bits and then
rounded to 32, is the correctly rounded 32-bit result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(c: Column) -> Column:
    """Rounded to single precision, kept as a double for further arithmetic."""
    return c.cast("float").cast("double")


def f32_div(a: Column, b: Column) -> Column:
    """NULL where ``b`` is zero."""
    return f32(F.try_divide(f32(a), f32(b)))


def f32_mul(a: Column, b: Column) -> Column:
    return f32(f32(a) * f32(b))


def pixel_index(x: Column, y: Column, width: Column) -> Column:
    """Row-major position."""
    return y.cast("bigint") * width + x


def pixel_xy(index: Column, width: Column) -> tuple[Column, Column]:
    """E25, inverse: (x, y)."""
    row = F.pmod(index, width)
    return row.cast("int"), F.floor((index - row) / width).cast("int")


def first_target(source: Column, scale: Column) -> Column:
    """First target row or column that reads ``source`` or a later source.

    Single-precision quotients grow with the target, and differ from exact ones by less than one
    target step, so of the three targets around the exact bound the right one is counted off.
    """
    bound = F.ceil(source * scale)
    reaches = lambda t: F.when(f32_div(t, scale) >= source, F.lit(1)).otherwise(F.lit(0))
    return (bound + 1 - reaches(bound) - reaches(bound - 1)).cast("int")


def target_range(source: Column, scale: Column, size: Column,
                 target_size: Column) -> tuple[Column, Column]:
    """(first, last) target row or column read from ``source``; first > last if there is none.

    The last source also serves all targets that would read past it.
    """
    last = F.when(source == size - 1, target_size).otherwise(first_target(source + 1, scale)) - 1
    return F.greatest(first_target(source, scale), F.lit(0)), F.least(last, target_size - 1)


def pack_position(part: Column, channel: Column) -> Column:
    """Place of a channel in its file as one number, ordered by part, then channel.  Minima of a
    number aggregate by hashing, minima of a struct only by sorting."""
    return F.shiftleft(part.cast("bigint"), 32) + channel


def unpack_position(position: Column) -> tuple[Column, Column]:
    """(part, channel)."""
    return (F.shiftright(position, 32).cast("int"),
            position.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))

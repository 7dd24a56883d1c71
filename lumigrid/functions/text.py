"""Text formatting and number mining for the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumigrid.functions.names import trimmed

# Unit names and canonical header keys.
SIZE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
HEADER_KEYS = {
    "display_window": "display_window",
    "pixel_aspect": "pixel_aspect",
    "pixel_aspect_ratio": "pixel_aspect",
    "chromaticities": "chromaticities",
    "time_code": "time_code",
}
FLOAT_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITE_TEXT = r"(?i)^[+-]?inf(inity)?$"
NAN_TEXT = r"(?i)^[+-]?nan$"


def fixed(x: Column, decimals: int) -> Column:
    """``decimals`` digits after the point, no thousands separator."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", x, F.lit(pattern))


def human_size(size: Column) -> Column:
    """1024 steps up to PiB; bytes as an integer, the rest with two decimals."""
    out = F.concat(fixed(size / float(1024 ** 5), 2), F.lit(f" {SIZE_UNITS[5]}"))
    for power in range(4, 0, -1):
        text = F.concat(fixed(size / float(1024 ** power), 2), F.lit(f" {SIZE_UNITS[power]}"))
        out = F.when(size < 1024 ** (power + 1), text).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)


def parse_float(s: Column) -> Column:
    """A number in plain or exponent notation, else null.  Java's type suffixes do not count."""
    return F.when(s.rlike(FLOAT_TEXT), s.try_cast("double"))


def pretty_number(s: Column, decimals: int) -> Column:
    """At most three decimals; what is no number stays as it is."""
    t = trimmed(s)
    return (F.when(t.rlike(INFINITE_TEXT), F.when(t.startswith("-"), "-inf").otherwise("inf"))
            .when(t.rlike(NAN_TEXT), F.lit("NaN"))
            .otherwise(F.coalesce(fixed(parse_float(t), min(decimals, 3)), s)))


def _mined(s: Column, pattern: str, dtype: str) -> Column:
    runs = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    return F.filter(F.transform(runs, lambda t: t.try_cast(dtype)), lambda n: n.isNotNull())


def ints_in_text(s: Column) -> Column:
    """Runs of digits and minus signs that are whole numbers."""
    return _mined(s, "[0-9-]+", "bigint")


def floats_in_text(s: Column) -> Column:
    """As E18 with the point allowed."""
    return _mined(s, "[0-9.-]+", "double")


def _pairs(nums: Column, count: int, zero: Column) -> list[Column]:
    """The first ``count`` pairs, both numbers zero where a pair is incomplete."""
    complete = [F.size(nums) >= 2 * i + 2 for i in range(count)]
    return [F.when(complete[i // 2], F.get(nums, F.lit(i))).otherwise(zero)
            for i in range(2 * count)]


def pretty_display_window(s: Column) -> Column:
    """The first two numbers are the position, the next two the size."""
    x, y, w, h = [n.cast("string") for n in _pairs(ints_in_text(s), 2, F.lit(0).cast("bigint"))]
    return F.concat(F.lit("position: ("), x, F.lit(", "), y, F.lit("); size: "), w, F.lit("x"), h)


def pretty_chromaticities(s: Column) -> Column:
    """Four (x,y) pairs with three decimals."""
    n = [fixed(v, 3) for v in _pairs(floats_in_text(s), 4, F.lit(0.0))]
    parts = [F.concat(F.lit(f"{label}: ("), n[2 * i], F.lit(","), n[2 * i + 1], F.lit(")"))
             for i, label in enumerate("RGBW")]
    return F.concat_ws("  ", *parts)


def pretty_time_code(s: Column) -> Column:
    """Without braces, commas become spaces."""
    return F.translate(s, ",{}", " ")


def header_key(k: Column) -> Column:
    """Canonical form of the known keys in any case, else the trimmed key."""
    t = trimmed(k)
    out = t
    for known, canonical in HEADER_KEYS.items():
        out = F.when(F.lower(t) == known, F.lit(canonical)).otherwise(out)
    return out


def header_value(key: Column, value: Column) -> Column:
    """Value of a header attribute, formatted by its canonical key."""
    return (F.when(key == "display_window", pretty_display_window(value))
            .when(key == "pixel_aspect", pretty_number(value, 3))
            .when(key == "chromaticities", pretty_chromaticities(value))
            .when(key == "time_code", pretty_time_code(value))
            .otherwise(value))

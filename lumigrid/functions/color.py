"""Pixel arithmetic: exposure, tone curves, gamma, quantisation, depth mapping.

All expressions stay inside whole-stage code generation.  Parameters may be Python numbers, which
fold into literals at plan time, or columns (one parameter set per row).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the filmic curve and limits of the gamma shortcuts.
ACES_A, ACES_B, ACES_C, ACES_D, ACES_E = 2.51, 0.03, 2.43, 0.59, 0.14
GAMMA_MIN = 1e-4
GAMMA_22_INVERSE = 0.45454545
GAMMA_TOLERANCE = 0.001
DEFAULT_EXPOSURE = 0.0
DEFAULT_GAMMA = 2.2

Number = float | int | Column


def _is_number(p: Number) -> bool:
    return isinstance(p, (int, float))


def clamp01(c: Column) -> Column:
    """Into 0..1; NaN stays NaN."""
    bounded = F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    return F.when(F.isnan(c.cast("double")), c.cast("double")).otherwise(bounded)


def finite_or(c: Column, default: float) -> Column:
    """``default`` in place of NaN and the infinities."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(math.inf)), F.lit(default)).otherwise(d)


def expose(c: Column, ev: Number) -> Column:
    """Times ``2**ev``."""
    factor = F.lit(2.0 ** ev) if _is_number(ev) else F.pow(F.lit(2.0), ev)
    return c * factor


def aces(x: Column) -> Column:
    """Rational filmic curve, clamped to 0..1."""
    return clamp01((x * (x * ACES_A + ACES_B)) / (x * (x * ACES_C + ACES_D) + ACES_E))


def reinhard(x: Column) -> Column:
    """``x / (x + 1)``."""
    return x / (x + 1.0)


CURVES = {"aces": aces, "reinhard": reinhard, "clamp": clamp01}


def gamma_encode(t: Column, gamma: Number = DEFAULT_GAMMA, mode: str = "reference") -> Column:
    """E13.  ``mode='reference'`` has shortcuts near gamma 2.2, 2.0 and 1.0; the one at 2.2 yields
    ``t**0.75``.  ``mode='exact'`` (D3) is the plain power."""
    shortcuts = [
        (GAMMA_22_INVERSE, lambda: F.sqrt(t) * F.sqrt(F.sqrt(t))),
        (0.5, lambda: F.sqrt(t)),
        (1.0, lambda: t),
    ] if mode == "reference" else []
    if _is_number(gamma):
        inverse = 1.0 / max(gamma, GAMMA_MIN)
        for centre, encoded in shortcuts:
            if abs(inverse - centre) < GAMMA_TOLERANCE:
                return encoded()
        return F.pow(t, F.lit(inverse))
    inverse = F.lit(1.0) / F.greatest(gamma, F.lit(GAMMA_MIN))
    out = F.pow(t, inverse)
    for centre, encoded in reversed(shortcuts):
        out = F.when(F.abs(inverse - centre) < GAMMA_TOLERANCE, encoded()).otherwise(out)
    return out


def quantize(t: Column, levels: int) -> Column:
    """Round ``t`` in 0..1 to 0..levels, halves up; NaN gives 0.  Adding a half and truncating stays in
    generated code, where ``round`` would go through a decimal per value."""
    return (F.nanvl(clamp01(t), F.lit(0.0)) * float(levels) + 0.5).cast("int")


def quantize8(t: Column) -> Column:
    """E14."""
    return quantize(t, 255)


def quantize16(t: Column) -> Column:
    """D4."""
    return quantize(t, 65535)


def dither_noise(x: Column, y: Column) -> Column:
    """Interleaved gradient noise in 0..1, a fixed function of the position."""
    fract = lambda c: c - F.floor(c)
    inner = fract(x.cast("double") * 0.06711056 + y.cast("double") * 0.00583715)
    return fract(inner * 52.9829189)


def quantize8_dithered(t: Column, x: Column, y: Column) -> Column:
    """Rounding threshold taken from the noise instead of one half."""
    return F.least((F.nanvl(clamp01(t), F.lit(0.0)) * 255.0 + dither_noise(x, y)).cast("int"), F.lit(255))


def encode_colour(c: Column, exposure: Number, gamma: Number, curve: str = "aces",
                  gamma_mode: str = "reference") -> Column:
    """One colour channel from scene value to 0..1."""
    safe = F.greatest(finite_or(c, 0.0), F.lit(0.0))
    return gamma_encode(CURVES[curve](expose(safe, exposure)), gamma, gamma_mode)


def encode_alpha(a: Column) -> Column:
    """Alpha is only made finite and clamped."""
    return clamp01(finite_or(a, 1.0))


def gray_max(r8: Column, g8: Column, b8: Column) -> Column:
    """E15."""
    return F.greatest(r8, g8, b8)


def depth_map(v: Column, lo: Column, hi: Column, invert: bool) -> Column:
    """Linear map of lo..hi to 0..255.  NaN gives 0, inverted or not, and NULL gives NULL."""
    d = v.cast("double")
    t = clamp01((d - lo) / (hi - lo))
    return F.when(F.isnan(d), F.lit(0)).when(d.isNotNull(), quantize8(1.0 - t if invert else t))

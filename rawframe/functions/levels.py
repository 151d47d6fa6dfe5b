"""Levels and curves of samples, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of the straight part in the curve of lossy files.
STRAIGHT = 1 / 16
# The tone curve of renderings.
TONE_LIFT, TOE_START, TOE_FLOOR = 1.5, 0.025, 0.3
OUTPUT_STEPS = 16384


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def pattern_at(pattern: Column, rows: int, cols: int, y: Column, x: Column) -> Column:
    """The entry of a repeating row-major pattern at (y, x)."""
    return F.element_at(pattern, (F.pmod(y, F.lit(rows)) * cols + F.pmod(x, F.lit(cols)) + 1).cast("int"))


def linear_value(v: Column, black: Column, white: Column, max_black: Column) -> Column:
    """0..65535 between black and white; every position is scaled by white less the highest black."""
    scale = F.when(white > max_black, 1.0 / F.nullif(white - max_black, F.lit(0.0))).otherwise(0.0)
    return F.round(clamped((v - black) * scale) * 65535.0).cast("int")


def lossy_decode(y: Column) -> Column:
    return y * STRAIGHT + y * y * y * (1 - STRAIGHT)


def lossy_encode(x: Column) -> Column:
    """The inverse of lossy_decode; exactly 0 and 1 at the ends.

    With y = u sinh t and u = 2 sqrt(p / 3), y^3 + p y = q turns into sinh 3t = 4 q / u^3."""
    p = STRAIGHT / (1 - STRAIGHT)
    u = 2 * (p / 3) ** 0.5
    y = F.sinh(F.asinh(x * (4 / (u**3 * (1 - STRAIGHT)))) / 3) * u
    return F.when(~(x > 0), 0.0).when(x >= 1, 1.0).otherwise(clamped(y))


def lossy_polynomial(lower: Column, span: Column) -> Column:
    """Coefficients that take a stored value to a linear one in [lower, lower + span]."""
    return F.array(lower, span * STRAIGHT, F.lit(0.0), span * (1 - STRAIGHT))


def srgb_encode(linear: Column) -> Column:
    curved = F.pow(linear, F.lit(1 / 2.4)) * 1.055 - 0.055
    return F.when(~(linear > 0), 0.0).when(linear >= 1, 1.0).when(linear <= 0.0031308, linear * 12.92).otherwise(curved)


def tone_curve(x: Column) -> Column:
    """Mid-tones lifted, then the shadows held down; 1 stays 1."""
    s2 = TOE_START**2
    x = clamped(x)
    toe = (x * x + TOE_FLOOR * s2) / (x * x + s2)
    return x * (1 + TONE_LIFT) / (x * TONE_LIFT + 1.0) * toe / ((1 + TOE_FLOOR * s2) / (1 + s2))


def output_value(linear: Column) -> Column:
    """8-bit output by way of the nearest of 16384 steps."""
    step = F.round(clamped(linear) * (OUTPUT_STEPS - 1)) / (OUTPUT_STEPS - 1)
    return F.round(srgb_encode(tone_curve(step)) * 255).cast("int")


def warp(k: list[float], r: Column) -> Column:
    """Radial warp of four coefficients in r squared."""
    x = r * r
    return F.lit(k[0]) + x * (F.lit(k[1]) + x * (F.lit(k[2]) + x * k[3]))


def gain(k: list[float], r: Column) -> Column:
    """Vignetting gain of five coefficients in r squared, 1 in the middle."""
    x, out = r * r, F.lit(k[4])
    for c in reversed(k[:4]):
        out = x * out + c
    return x * out + 1.0

"""Depth, colour and camera expressions.

Depth and colour stay FLOAT: Spark's ``/`` widens to DOUBLE, so each quotient is
cast back, and thresholds are cast to FLOAT before they are compared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.checks import finite

FX = FY = 525.0
CX, CY = 319.5, 239.5
MIN_DEPTH, MAX_DEPTH = 0.1, 5.0


def single(value: float) -> Column:
    """A FLOAT literal."""
    return F.lit(float(value)).cast("float")


def depth_to_metres(raw: Column, scale: float = 5000.0) -> Column:
    return (raw.cast("float") / single(scale)).cast("float")


def valid_depth(depth: Column, low: float = MIN_DEPTH, high: float = MAX_DEPTH) -> Column:
    """Both ends belong to the range."""
    return finite(depth) & (depth >= single(low)) & (depth <= single(high))


def on_stride(v: Column, u: Column, stride: int) -> Column:
    if stride < 1:
        raise ValueError("the stride is at least 1")
    return (v % stride == 0) & (u % stride == 0)


def unit_colour(channel: Column) -> Column:
    """An 8-bit channel as FLOAT from 0 to 1."""
    return (channel.cast("float") / single(255)).cast("float")


def pinhole(pixel: Column, z: Column, focal: float, centre: float) -> Column:
    """A camera coordinate of a pixel at depth z: ((pixel - centre) * z) / focal."""
    return (pixel.cast("double") - F.lit(float(centre))) * z.cast("double") / F.lit(float(focal))


def voxel_index(coordinate: Column, size: float) -> Column:
    """The cell of a coordinate, floored in DOUBLE."""
    return F.floor(coordinate.cast("double") / F.lit(float(size))).cast("bigint")


def byte_colour(channel: Column, scale: Column | float = 1.0) -> Column:
    """A channel times ``scale``, rounded half to even and clipped to 0-255.
    The product has the channel's own precision: give FLOAT for FLOAT."""
    factor = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.least(F.greatest(F.rint(channel * factor), F.lit(0.0)), F.lit(255.0)).cast("int")


def blend(base: Column, over: Column, alpha: float = 0.45) -> Column:
    """(1 - alpha) * base + alpha * over, clipped to 0-255, the rest cut off."""
    mixed = F.lit(1.0 - alpha) * base.cast("double") + F.lit(float(alpha)) * over.cast("double")
    return F.least(F.greatest(mixed, F.lit(0.0)), F.lit(255.0)).cast("int")


def hsv_channels(hue: Column, saturation: float, value: float) -> dict[str, Column]:
    """Red, green and blue of a hue in [0, 1), by sextants."""
    i = F.floor(hue * 6.0)
    f = hue * 6.0 - i.cast("double")
    s, v = float(saturation), F.lit(float(value))
    p = F.lit(float(value) * (1.0 - s))
    q = v * (F.lit(1.0) - F.lit(s) * f)
    t = v * (F.lit(1.0) - F.lit(s) * (F.lit(1.0) - f))
    by_sextant = {"r": (v, q, p, p, t, v), "g": (t, v, v, q, p, p), "b": (p, p, t, v, v, q)}
    out = {}
    for name, choices in by_sextant.items():
        pick = F.when(i == 0, choices[0])
        for k in range(1, 5):
            pick = pick.when(i == k, choices[k])
        out[name] = pick.otherwise(choices[5]).cast("float")
    return out

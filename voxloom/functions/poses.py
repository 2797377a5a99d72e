"""Rigid-body expressions: a pose is twelve DOUBLE columns on the frame's row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.checks import require

ROTATION = ("r00", "r01", "r02", "r10", "r11", "r12", "r20", "r21", "r22")
TRANSLATION = ("tx", "ty", "tz")


def pose_rotation(qx: Column, qy: Column, qz: Column, qw: Column) -> dict[str, Column]:
    """The rotation of a quaternion, normalised first; a zero one is an error."""
    q = [c.cast("double") for c in (qx, qy, qz, qw)]
    norm = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    x, y, z, w = (c / require(norm > 0, norm, "a quaternion must not be zero") for c in q)
    one, two = F.lit(1.0), F.lit(2.0)
    rows = (
        one - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w),
        two * (x * y + z * w), one - two * (x * x + z * z), two * (y * z - x * w),
        two * (x * z - y * w), two * (y * z + x * w), one - two * (x * x + y * y),
    )
    return dict(zip(ROTATION, rows, strict=True))


def place(x: Column, y: Column, z: Column, pose: dict[str, Column] | None = None) -> tuple[Column, Column, Column]:
    """World coordinates of a camera point; by default with columns r00 ... tz."""
    p = pose or {k: F.col(k) for k in ROTATION + TRANSLATION}
    x, y, z = (c.cast("double") for c in (x, y, z))
    return tuple(x * p[f"r{k}0"] + y * p[f"r{k}1"] + z * p[f"r{k}2"] + p[t] for k, t in enumerate(TRANSLATION))


def distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    total = None
    for p, q in zip(a, b, strict=True):
        total = (p - q) * (p - q) if total is None else total + (p - q) * (p - q)
    return F.sqrt(total)

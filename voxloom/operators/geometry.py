"""Pixels to camera points to world points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.checks import finite, require_rows
from voxloom.functions.pixels import CX, CY, FX, FY, MAX_DEPTH, MIN_DEPTH, on_stride, pinhole, valid_depth
from voxloom.functions.poses import ROTATION, TRANSLATION, place, pose_rotation


def image_pixels(images: DataFrame, values: str, width: int, name: str) -> DataFrame:
    """A row for each element of a row-major image array, with v and u."""
    exploded = images.select("*", F.posexplode(values).alias("__at", name)).drop(values)
    v = F.floor(F.col("__at") / width).cast("int")
    return exploded.withColumn("v", v).withColumn("u", (F.col("__at") % width).cast("int")).drop("__at")


def backproject(
    pixels: DataFrame, stride: int = 4, fx: float = FX, fy: float = FY, cx: float = CX, cy: float = CY,
    low: float = MIN_DEPTH, high: float = MAX_DEPTH, carry: list[str] | None = None,
) -> DataFrame:
    """Camera points x, y, z of the valid pixels on the stride.

    ``pixels`` has v, u and depth (metres, FLOAT); u and v stay those of the full
    image.  ``carry`` names the columns that pass through: none but the image's
    keys for geometry, labels and confidences for semantics.
    """
    kept = pixels.filter(on_stride(F.col("v"), F.col("u"), stride) & valid_depth(F.col("depth"), low, high))
    z = F.col("depth").cast("double")
    return kept.select(
        *(carry or []), "v", "u",
        pinhole(F.col("u"), F.col("depth"), fx, cx).alias("x"), pinhole(F.col("v"), F.col("depth"), fy, cy).alias("y"), z.alias("z"),
    )


def pose_matrices(poses: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, the nine rotation columns and the translation of each pose."""
    rotation = pose_rotation(*(F.col(c) for c in ("qx", "qy", "qz", "qw")))
    return poses.select(*keys, *[c.alias(n) for n, c in rotation.items()], *[F.col(t).cast("double").alias(t) for t in TRANSLATION])


def to_world(points: DataFrame, matrices: DataFrame, keys: list[str]) -> DataFrame:
    """Points with x, y, z in the world; each is joined to its frame's pose.
    Points that are not finite are an error.

    One row a frame meets many rows of points: adaptive execution broadcasts the
    poses when they prove small and splits a frame that is hot.
    """
    checked = require_rows(points, finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")), "points must be finite")
    joined = checked.join(matrices.select(*keys, *ROTATION, *TRANSLATION), keys)
    x, y, z = place(F.col("x"), F.col("y"), F.col("z"))
    others = [c for c in points.columns if c not in ("x", "y", "z")]
    return joined.select(*others, x.alias("x"), y.alias("y"), z.alias("z"))


def bounds(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Least, largest and mean coordinate."""
    found = []
    for c in "xyz":
        found += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"mean_{c}")]
    return points.groupBy(*(by or [])).agg(*found)


#: Where the camera stands from the centre, before it is normalised.
CAMERA_DIRECTION = (1.3, -1.3, 0.9)


def fixed_camera(points: DataFrame) -> DataFrame:
    """The camera that sees a whole map: centre, eye, up, near and far, one row."""
    box = points.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    extent = [F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"]
    length = F.sqrt(extent[0] * extent[0] + extent[1] * extent[1] + extent[2] * extent[2])
    radius = F.greatest(length / 2.0, F.lit(0.1))
    reach = sum(d * d for d in CAMERA_DIRECTION) ** 0.5
    away = F.lit(3.0) * radius
    columns: list[Column] = []
    for c, d in zip("xyz", CAMERA_DIRECTION, strict=True):
        centre = (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2.0
        columns += [centre.alias(f"center_{c}"), (centre + F.lit(d / reach) * away).alias(f"eye_{c}"), F.lit(1.0 if c == "z" else 0.0).alias(f"up_{c}")]
    near = F.greatest(F.lit(0.01), away - F.lit(2.0) * radius)
    return box.select(*columns, near.alias("near_clip"), (away + F.lit(2.5) * radius).alias("far_clip"))

"""Voxel fusion as one commutative aggregation.

``partials`` holds sums for each (voxel, label): adding partials of any split
of the observations gives the partials of all of them, so batch, incremental,
streaming and snapshot maps are the same aggregation at other times.  Sums keep
the type of their column: DECIMAL sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.checks import finite, positive, require_any, require_rows
from voxloom.functions.pixels import voxel_index

KEYS = ("ix", "iy", "iz")
SUMS = {"x": "sx", "y": "sy", "z": "sz", "r": "sr", "g": "sg", "b": "sb", "conf": "sconf"}


def checked_observations(obs: DataFrame) -> DataFrame:
    """Fails on coordinates, colours or confidences that are not finite and on
    confidences outside 0 to 1."""
    rule = (F.col("conf") >= 0) & (F.col("conf") <= 1)
    for name in SUMS:
        rule = rule & finite(F.col(name))
    return require_rows(obs, rule, "observations must be finite, with confidences from 0 to 1")


def partials(obs: DataFrame, size: float, by: list[str] | None = None, seen: Column | None = None) -> DataFrame:
    """Sums for each (voxel, label), and for each of ``by`` if given.

    ``obs`` has x, y, z, r, g, b, conf and label; ``seen`` orders observations
    for ties by first sight.
    """
    size = positive("the voxel size", size)
    keys = [voxel_index(F.col(c), size).alias(k) for c, k in zip("xyz", KEYS, strict=True)]
    first = [] if seen is None else [F.min(seen).alias("first_seen")]
    sums = [F.sum(c).alias(s) for c, s in SUMS.items()]
    return obs.groupBy(*(by or []), *keys, "label").agg(*sums, F.count("*").alias("n"), *first)


def merge(*parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The partials of all observations behind ``parts``."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    first = [F.min("first_seen").alias("first_seen")] if "first_seen" in every.columns else []
    sums = [F.sum(s).alias(s) for s in SUMS.values()]
    return every.groupBy(*(by or []), *KEYS, "label").agg(*sums, F.sum("n").alias("n"), *first)


def finalize(parts: DataFrame, tie: str = "lowest_label", by: list[str] | None = None) -> DataFrame:
    """The voxel map of partials: the label of the largest confidence sum, ties
    to the lowest label or to the one seen first."""
    order = {"lowest_label": F.col("label"), "first_seen": F.col("first_seen") if "first_seen" in parts.columns else None}.get(tie)
    if order is None:
        raise ValueError("tie is lowest_label, or first_seen with partials that have first_seen")
    n = F.sum("n").cast("double")
    total = F.sum("sconf").cast("double")
    best = F.max("sconf").cast("double")
    means = [(F.sum(SUMS[c]).cast("double") / n).cast("float").alias(c) for c in "xyzrgb"]
    return parts.groupBy(*(by or []), *KEYS).agg(
        *means,
        F.min_by("label", F.struct(-F.col("sconf"), order)).cast("bigint").alias("label"),
        F.when(total > 0, best / total).otherwise(0.0).cast("float").alias("semantic_agreement"),
        F.when(n > 0, total / n).otherwise(0.0).cast("float").alias("mean_model_confidence"),
        F.sum("n").cast("int").alias("observation_count"),
    )


def voxel_map(obs: DataFrame, size: float, tie: str = "lowest_label", seen: Column | None = None, strict: bool = False) -> DataFrame:
    """Fuses observations in one batch; ``strict`` fails on an empty input."""
    if strict:
        require_any(obs, "there are no observations to fuse")
    return finalize(partials(obs, size, seen=seen), tie)


def downsample(points: DataFrame, size: float, by: list[str] | None = None) -> DataFrame:
    """Mean position and colour of each voxel: one shuffle of partial sums."""
    size = positive("the voxel size", size)
    keys = [voxel_index(F.col(c), size).alias(k) for c, k in zip("xyz", KEYS, strict=True)]
    n = F.count("*").cast("double")
    means = [(F.sum(c).cast("double") / n).cast("float").alias(c) for c in "xyzrgb"]
    return points.groupBy(*(by or []), *keys).agg(*means)


def voxel_count(parts: DataFrame) -> DataFrame:
    """The number of voxels: one row, voxels."""
    return parts.select(*KEYS).distinct().agg(F.count("*").alias("voxels"))

"""Quality metrics, histograms, sweeps and captions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.checks import positive
from voxloom.functions.pixels import single, voxel_index
from voxloom.session import saved


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE, 0 where there is no whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def fusion_quality(voxels: DataFrame, low_agreement: float = 0.6) -> DataFrame:
    """One row: observations, voxels, retention, mean observations, share seen
    more than once, mean agreement, share of low agreement."""
    n, total = F.count("*"), F.coalesce(F.sum(F.col("observation_count").cast("bigint")), F.lit(0))
    some = lambda rule: F.coalesce(F.sum(rule.cast("bigint")), F.lit(0))
    return voxels.agg(
        total.alias("raw_points"),
        n.alias("voxels"),
        ratio(n, total).alias("retention_ratio"),
        ratio(total, n).alias("mean_observations"),
        ratio(some(F.col("observation_count") > 1), n).alias("multi_observation_ratio"),
        F.round(F.avg(F.col("semantic_agreement").cast("double")), 6).alias("mean_agreement"),
        ratio(some(F.col("semantic_agreement") < single(low_agreement)), n).alias("low_agreement_ratio"),
    )


def class_histogram(pixels: DataFrame, label: str = "label") -> DataFrame:
    """Pixels and share of each label."""
    counts = pixels.groupBy(label).agg(F.count("*").alias("pixels"))
    total = counts.agg(F.sum("pixels").alias("__total"))
    return counts.join(total).select(label, "pixels", ratio(F.col("pixels"), F.col("__total")).alias("ratio"))


def top_classes(histogram: DataFrame, n: int = 15, label: str = "label") -> DataFrame:
    """The most frequent labels, ties to the larger id."""
    return histogram.orderBy(F.col("pixels").desc(), F.col(label).desc()).limit(n)


def sweep(points: DataFrame, grid: DataFrame, index: str = "rec_idx") -> DataFrame:
    """For each (frame_step, voxel_size_m) of a small grid: selected frames,
    raw and downsampled points and the retention ratio.

    The grid is a handful of rows; points are read once and each is counted for
    every setting that selects its frame.  Voxels are counted by a distinct
    aggregation with partial sums on the map side.
    """
    chosen = points.join(F.broadcast(grid), F.col(index) % F.col("frame_step") == 0)
    keys = [F.floor(F.col(c).cast("double") / F.col("voxel_size_m")).cast("bigint").alias(f"__{c}") for c in "xyz"]
    voxels = chosen.groupBy("frame_step", "voxel_size_m", *keys).agg(F.count("*").alias("__n"))
    counts = voxels.groupBy("frame_step", "voxel_size_m").agg(
        F.sum("__n").alias("raw_point_count"), F.count("*").alias("downsampled_point_count")
    )
    frames = points.select(index).distinct().join(F.broadcast(grid.select("frame_step").distinct()), F.col(index) % F.col("frame_step") == 0)
    frames = frames.groupBy("frame_step").agg(F.count("*").alias("selected_frames"))
    joined = counts.join(frames, "frame_step")
    kept = F.round(ratio(F.col("downsampled_point_count"), F.col("raw_point_count")), 6)
    return joined.select("frame_step", "voxel_size_m", "selected_frames", "raw_point_count", "downsampled_point_count", kept.alias("retention_ratio"))


def voxel_cells(points: DataFrame, size: float) -> DataFrame:
    """Distinct cells of points."""
    size = positive("the voxel size", size)
    return points.select(*[voxel_index(F.col(c), size).alias(f"i{c}") for c in "xyz"]).distinct()


def percentile(df: DataFrame, column: str, q: float = 0.98, name: str = "value") -> DataFrame:
    """The exact percentile with linear interpolation, one row (null where
    there are no values; null and NaN are none).

    Values are counted, with partial counts on the map side, and dealt by range;
    the sizes of the ranges (one number a partition) tell in which one a rank
    lies, and only that one is summed up in order.  No task holds all values.
    """
    if not 0 <= q <= 1:
        raise ValueError("a percentile lies from 0 to 1")
    spark = df.sparkSession
    value = F.col(column).cast("double").alias("__v")
    counts = df.select(value).filter("__v is not null and not isnan(__v)").groupBy("__v").agg(F.count("*").alias("__n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(counts.repartitionByRange(parts, "__v").withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = sorted(tuple(r) for r in dealt.groupBy("__part").agg(F.sum("__n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        return spark.createDataFrame([(None,)], f"{name} double")
    at = q * (total - 1)
    ranks = (math.floor(at), math.ceil(at))

    def ranked(rank: int) -> float:
        before = 0
        for part, n in sizes:
            if rank < before + n:
                break
            before += n
        upto = F.sum("__n").over(Window.partitionBy("__part").orderBy("__v"))
        own = dealt.filter(F.col("__part") == part).withColumn("__upto", upto)
        return own.filter(F.col("__upto") > rank - before).agg(F.min("__v")).first()[0]

    low = ranked(ranks[0])
    high = low if ranks[1] == ranks[0] else ranked(ranks[1])
    return spark.createDataFrame([(low + (high - low) * (at - ranks[0]),)], f"{name} double")


def experiment_rows(
    swept: DataFrame, pixel_stride: int, build_seconds: Column, ply_bytes: Column, output_path: Column, notes: Column
) -> DataFrame:
    """Rows of a sweep as the experiment table has them (schemas.EXPERIMENT)."""
    positive("the pixel stride", pixel_stride)
    size = F.round(ply_bytes.cast("double") / F.lit(float(1 << 20)), 6)
    return swept.select(
        "frame_step", "voxel_size_m", F.lit(pixel_stride).alias("pixel_stride"), F.col("selected_frames").cast("int").alias("selected_frames"),
        "raw_point_count", "downsampled_point_count", "retention_ratio", build_seconds.cast("double").alias("build_time_seconds"),
        size.alias("ply_size_mb"), output_path.alias("output_path"), notes.alias("notes"),
    )


def report_lines(quality: DataFrame) -> DataFrame:
    """The row of ``fusion_quality`` as text: place and line; numbers are
    rounded half to even before they are printed."""
    n = lambda c: F.format_number(c, 0)
    share = lambda c: F.format_string("%.2f%%", F.rint(F.col(c) * 10_000) / 100)
    lines = (
        F.concat(F.lit("Raw observations: "), n("raw_points")), F.concat(F.lit("Map voxels: "), n("voxels")),
        F.concat(F.lit("Retention: "), share("retention_ratio")),
        F.concat(F.lit("Mean observations per voxel: "), F.format_string("%.2f", F.rint(F.col("mean_observations") * 100) / 100)),
        F.concat(F.lit("Voxels seen more than once: "), share("multi_observation_ratio")),
        F.concat(F.lit("Mean semantic agreement: "), F.format_string("%.4f", F.rint(F.col("mean_agreement") * 10_000) / 10_000)),
        F.concat(F.lit("Voxels of low agreement: "), share("low_agreement_ratio")),
    )
    return quality.select(F.posexplode(F.array(*lines)).alias("place", "line"))


def caption(frame: Column, frames: Column, voxels: Column, points: Column) -> Column:
    """The line under a rendered frame (``frame`` from 0)."""
    gap = F.lit("    |    ")
    return F.concat(
        F.lit("Frame "), (frame + 1).cast("string"), F.lit("/"), frames.cast("string"), gap,
        F.lit("Map voxels: "), F.format_number(voxels, 0), gap, F.lit("Current observations: "), F.format_number(points, 0),
    )


def frame_schedule(frames: DataFrame, index: str, fps: float, hold_seconds: float) -> DataFrame:
    """How often each frame of a film is shown: once, the last for the hold too."""
    positive("frames a second", fps)
    last = frames.agg(F.max(index).alias("__last"))
    return frames.join(last).withColumn("repeats", F.when(F.col(index) == F.col("__last"), 1 + round(hold_seconds * fps)).otherwise(1)).drop("__last")

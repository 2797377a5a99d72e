"""From a recorded folder to maps: ``python -m voxloom.build --sequence ...``.

The folder holds rgb.txt, depth.txt, groundtruth.txt and the images they name.
Written below ``--output``: snapshots (a partition a frame), points (the
observations of each frame), map (the last voxel map), map.ply and
experiments (one CSV row).  Labels come from an ONNX model (``--onnx``) or from
any factory of predictors (``--predictor module:function``).
"""

from __future__ import annotations

import argparse
import importlib
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom import replay
from voxloom.functions.checks import require_any
from voxloom.functions.pixels import CX, CY, FX, FY
from voxloom.operators import fusion, metrics, semantics, snapshots
from voxloom.session import saved
from voxloom.sinks import maps, ply
from voxloom.sources import sequence


@dataclass(frozen=True)
class Settings:
    """What is built, and how."""

    sequence: str
    output: str
    frame_step: int = 10
    pixel_stride: int = 4
    voxel_size: float = 0.02
    every: int = 5
    depth_scale: float = 5000.0
    fx: float = FX
    fy: float = FY
    cx: float = CX
    cy: float = CY
    notes: str = ""


def sequence_observations(spark: SparkSession, s: Settings, make: Callable[[], semantics.Predictor]) -> DataFrame:
    """World points of the selected frames of one recorded folder."""
    folder = s.sequence.rstrip("/")
    rgb, depth = (sequence.read_index(spark, f"{folder}/{name}.txt") for name in ("rgb", "depth"))
    records = replay.associate(rgb, depth, sequence.read_poses(spark, f"{folder}/groundtruth.txt"))
    frames = require_any(saved(replay.selected(records, s.frame_step)), "no frame has a colour image, a depth image and a pose")
    images = sequence.read_images(spark, folder)
    return replay.semantic_observations(frames, images, make, s.pixel_stride, s.depth_scale, s.fx, s.fy, s.cx, s.cy)


def build(spark: SparkSession, s: Settings, make: Callable[[], semantics.Predictor]) -> DataFrame:
    """Writes everything below ``s.output``; returns the experiment's row."""
    began = time.perf_counter()
    out = s.output.rstrip("/")
    obs = saved(sequence_observations(spark, s, make), "observations")
    frames = saved(fusion.partials(obs, s.voxel_size, by=["frame_idx"]), "frames")
    snapshots.whole_snapshots(frames, s.every).write.mode("overwrite").partitionBy("snapshot_frame").parquet(f"{out}/snapshots")
    replay.frame_points(obs).write.mode("overwrite").parquet(f"{out}/points")
    fusion.finalize(fusion.merge(frames.drop("frame_idx"))).write.mode("overwrite").parquet(f"{out}/map")
    whole = spark.read.parquet(f"{out}/map")
    ply.write_ply(whole, f"{out}/map.ply", list(fusion.KEYS))
    seconds = time.perf_counter() - began
    size = spark.read.format("binaryFile").load(f"{out}/map.ply").select("length").first()[0]
    counted = obs.agg(F.count_distinct("frame_idx").alias("selected_frames"), F.count("*").alias("raw_point_count"))
    kept = whole.agg(F.count("*").alias("downsampled_point_count"))
    ratio = F.round(metrics.ratio(F.col("downsampled_point_count"), F.col("raw_point_count")), 6)
    swept = counted.join(kept).select(
        F.lit(s.frame_step).alias("frame_step"), F.lit(s.voxel_size).alias("voxel_size_m"), "*", ratio.alias("retention_ratio")
    )
    row = metrics.experiment_rows(swept, s.pixel_stride, F.lit(seconds), F.lit(size), F.lit(f"{out}/map.ply"), F.lit(s.notes))
    maps.write_experiments(row, f"{out}/experiments")
    return row


def parse_arguments(argv: list[str] | None = None) -> tuple[Settings, Callable[[], semantics.Predictor]]:
    parser = argparse.ArgumentParser(description="Build a semantic voxel map of a recorded folder.")
    parser.add_argument("--sequence", required=True)
    parser.add_argument("--output", required=True)
    for name, value in Settings.__dataclass_fields__.items():
        if name not in ("sequence", "output"):
            parser.add_argument("--" + name.replace("_", "-"), type=type(value.default), default=value.default)
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--onnx", help="a segmentation model whose first output is logits (1, classes, h, w)")
    source.add_argument("--predictor", help="module:function that makes a predictor")
    given = vars(parser.parse_args(argv))
    onnx, predictor = given.pop("onnx"), given.pop("predictor")
    if onnx:
        return Settings(**given), semantics.OnnxPredictor.of_file(onnx)
    module, _, function = predictor.partition(":")
    return Settings(**given), getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None) -> None:
    from voxloom.session import session

    settings, make = parse_arguments(argv)
    spark = session("build")
    build(spark, settings, make)
    lines = metrics.report_lines(metrics.fusion_quality(spark.read.parquet(f"{settings.output.rstrip('/')}/map")))
    for row in lines.orderBy("place").collect():  # seven lines
        print(row["line"])


if __name__ == "__main__":
    main()

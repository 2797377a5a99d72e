"""From recorded sequence folders to maps, snapshots, sweeps and a replay table.

    records      = associate(read_index(rgb), read_index(depth), read_poses(...))
    observations = semantic_observations(selected(records), images, predictor)
    voxels       = fusion.voxel_map(observations, 0.02)

``python -m voxloom.build`` takes a recorded folder to snapshots and a map;
``python -m voxloom.replay --snapshots ... --points ... --output ...`` writes
what a renderer needs of each snapshot: thresholded labels with colours, the
caption, the fixed camera, how often the frame is shown, and its settings.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.checks import positive
from voxloom.functions.pixels import CX, CY, FX, FY, depth_to_metres, unit_colour
from voxloom.operators import association as assoc
from voxloom.operators import fusion, geometry, metrics, selection, semantics
from voxloom.sources.png import decode_png, rgb_only

MAX_TIME_DIFFERENCE, POSE_TOLERANCE = 0.03, 0.02
POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def associate(rgb: DataFrame, depth: DataFrame, poses: DataFrame, width: float = MAX_TIME_DIFFERENCE, tolerance: float = POSE_TOLERANCE) -> DataFrame:
    """Records: colour and depth entries matched one to one, each with the pose
    nearest to its depth time, numbered by depth time in each sequence."""
    a, b = (
        x.select("seq_id", F.col("idx").alias(f"{n}_idx"), F.col("t").alias(f"{n}_t"), F.col("path").alias(f"{n}_path"))
        for x, n in ((rgb, "rgb"), (depth, "depth"))
    )
    gap = assoc.time_difference(F.col("rgb_t"), F.col("depth_t"))
    pairs = assoc.band_join(a, b, "rgb_t", "depth_t", width, ["seq_id"]).withColumn("difference", gap)
    matched = assoc.match_greedy(pairs, "seq_id", "rgb_idx", "depth_idx", "difference")
    track = poses.select("seq_id", F.col("idx").alias("pose_idx"), F.col("t").alias("pose_t"), *POSE)
    posed = assoc.nearest_asof(matched, track, "seq_id", "depth_idx", "depth_t", "pose_idx", "pose_t", tolerance)
    return assoc.in_depth_order(posed, "seq_id", "depth_t", "difference", "rgb_idx", "depth_idx")


def selected(records: DataFrame, frame_step: int = 20) -> DataFrame:
    """Every ``frame_step``-th record, numbered as frames: frame_idx."""
    return selection.every_nth(records, frame_step).withColumn("frame_idx", F.floor(F.col("rec_idx") / frame_step).cast("int"))


def image_key(path: str = "path") -> list:
    """The sequence, and the path below it, of an image file."""
    parts = F.split(F.col(path), "/")
    below = F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
    return [F.element_at(parts, -3).alias("seq_id"), below.alias("below"), F.col("content")]


def with_images(frames: DataFrame, images: DataFrame) -> DataFrame:
    """Adds rgb and depth (PNG binaries) to frames; only the files they name are
    read past the join."""
    files = images.select(*image_key())
    rgb = files.select("seq_id", F.col("below").alias("rgb_path"), F.col("content").alias("rgb"))
    depth = files.select("seq_id", F.col("below").alias("depth_path"), F.col("content").alias("depth"))
    return frames.join(rgb, ["seq_id", "rgb_path"]).join(depth, ["seq_id", "depth_path"])


PIXELS = "seq_id string, frame_idx int, v int, u int, red smallint, green smallint, blue smallint, raw int, label bigint, pconf float"


def semantic_pixels(frames: DataFrame, make: Callable[[], semantics.Predictor], stride: int = 4) -> DataFrame:
    """Decodes and segments each frame once; pixels on the stride come out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make()
        for batch in batches:
            for row in batch.to_dict("records"):
                rgb, depth = np.ascontiguousarray(rgb_only(decode_png(row["rgb"]))), decode_png(row["depth"])
                labels, confidence = predictor.predict(rgb)
                if depth.shape != rgb.shape[:2] or labels.shape != depth.shape or confidence.shape != depth.shape:
                    raise ValueError("colour, depth, labels and confidences differ in size")
                v, u = (x.ravel() for x in np.mgrid[0 : depth.shape[0] : stride, 0 : depth.shape[1] : stride])
                colour = rgb[v, u].astype(np.int16)
                yield pd.DataFrame(
                    {
                        "seq_id": row["seq_id"], "frame_idx": row["frame_idx"], "v": v, "u": u, "red": colour[:, 0], "green": colour[:, 1],
                        "blue": colour[:, 2], "raw": depth[v, u].astype(np.int32), "label": labels[v, u], "pconf": confidence[v, u],
                    }
                )

    return frames.select("seq_id", "frame_idx", "rgb", "depth").mapInPandas(run, PIXELS)


def semantic_observations(
    frames: DataFrame, images: DataFrame, make: Callable[[], semantics.Predictor], stride: int = 4, scale: float = 5000.0,
    fx: float = FX, fy: float = FY, cx: float = CX, cy: float = CY,
) -> DataFrame:
    """World points with colour, label and confidence of all frames."""
    pixels = semantic_pixels(with_images(frames, images), make, stride)
    colours = [unit_colour(F.col(n)).alias(c) for n, c in (("red", "r"), ("green", "g"), ("blue", "b"))]
    metric = pixels.select("seq_id", "frame_idx", "v", "u", depth_to_metres(F.col("raw"), scale).alias("depth"), *colours, "label", F.col("pconf").alias("conf"))
    keys = ["seq_id", "frame_idx"]
    points = geometry.backproject(metric, 1, fx, fy, cx, cy, carry=[*keys, "r", "g", "b", "label", "conf"])
    return fusion.checked_observations(geometry.to_world(points, geometry.pose_matrices(frames, keys), keys))


def replay_table(snapshots: DataFrame, current: DataFrame, fps: float, hold_seconds: float, least_agreement: float, least_confidence: float) -> DataFrame:
    """A row for each snapshot: caption, unknown share and repeats.

    ``current`` has snapshot_frame and points, the observations of its frame.
    """
    from voxloom.operators.snapshots import snapshot_metrics

    counts = snapshot_metrics(snapshots, least_agreement, least_confidence).join(current, "snapshot_frame", "left")
    numbered = selection.numbered(counts, ["snapshot_frame"], "place")
    total = counts.agg(F.count("*").alias("total"))
    scheduled = metrics.frame_schedule(numbered, "place", fps, hold_seconds).join(total)
    text = metrics.caption(F.col("place"), F.col("total"), F.col("voxels"), F.coalesce("points", F.lit(0)))
    return scheduled.select("snapshot_frame", "voxels", "unknown_ratio", text.alias("caption"), "repeats")


def frame_points(obs: DataFrame, frame: str = "frame_idx") -> DataFrame:
    """snapshot_frame and points: the observations of each frame itself."""
    return obs.groupBy(F.col(frame).cast("int").alias("snapshot_frame")).agg(F.count("*").alias("points"))


def grown_points(snapshots: DataFrame) -> DataFrame:
    """snapshot_frame and points: what each snapshot has beyond the one before;
    where every frame has its snapshot that is the frame's observations."""
    totals = snapshots.groupBy("snapshot_frame").agg(F.sum(F.col("observation_count").cast("bigint")).alias("n"))
    before = selection.numbered(totals, ["snapshot_frame"], "place")
    earlier = before.select((F.col("place") + 1).alias("place"), F.col("n").alias("m"))
    return before.join(earlier, "place", "left").select("snapshot_frame", (F.col("n") - F.coalesce("m", F.lit(0))).alias("points"))


def coloured_snapshots(spark: SparkSession, snapshots: DataFrame, least_agreement: float, least_confidence: float) -> DataFrame:
    """Snapshot voxels with thresholded labels and their palette colours."""
    label = semantics.unknown_label(F.col("label"), F.col("semantic_agreement"), F.col("mean_model_confidence"), least_agreement, least_confidence)
    rows = snapshots.select("snapshot_frame", "x", "y", "z", label.alias("label"))
    return semantics.coloured(rows, semantics.hsv_palette(spark))


@dataclass(frozen=True)
class Parameters:
    """What the replay is asked for."""

    snapshots: str
    output: str
    points: str | None = None
    fps: float = 5.0
    agreement: float = semantics.AGREEMENT
    confidence: float = semantics.CONFIDENCE
    hold_seconds: float = 2.0
    layout: str = "map"
    point_size: float = 3.0


def parse_arguments(argv: list[str] | None = None) -> Parameters:
    parser = argparse.ArgumentParser(description="Prepare a replay of map snapshots.")
    parser.add_argument("--snapshots", required=True, help="the snapshot table")
    parser.add_argument("--output", required=True, help="a folder for the replay tables")
    parser.add_argument("--points", default=None, help="a table of snapshot_frame and points, the observations of each frame")
    parser.add_argument("--fps", type=float, default=Parameters.fps)
    parser.add_argument("--agreement", type=float, default=Parameters.agreement)
    parser.add_argument("--confidence", type=float, default=Parameters.confidence)
    parser.add_argument("--hold-seconds", type=float, default=Parameters.hold_seconds)
    parser.add_argument("--layout", choices=("map", "triple"), default=Parameters.layout, help="the map alone, or beside image and overlay")
    parser.add_argument("--point-size", type=float, default=Parameters.point_size)
    return Parameters(**vars(parser.parse_args(argv)))


def main(argv: list[str] | None = None) -> None:
    from voxloom.session import session
    from voxloom.sources.sequence import read_snapshots

    p = parse_arguments(argv)
    size = positive("the point size", p.point_size)
    spark = session("replay")
    snapshots = read_snapshots(spark, p.snapshots)
    current = spark.read.parquet(p.points) if p.points else grown_points(snapshots)
    last = snapshots.join(snapshots.agg(F.max("snapshot_frame").alias("last")), F.col("snapshot_frame") == F.col("last"))
    replay_table(snapshots, current, p.fps, p.hold_seconds, p.agreement, p.confidence).write.mode("overwrite").parquet(f"{p.output}/frames")
    coloured_snapshots(spark, snapshots, p.agreement, p.confidence).write.mode("overwrite").partitionBy("snapshot_frame").parquet(f"{p.output}/voxels")
    settings = spark.createDataFrame([(p.layout, size, p.fps, p.hold_seconds)], "layout string, point_size double, fps double, hold_seconds double")
    settings.write.mode("overwrite").parquet(f"{p.output}/settings")
    geometry.fixed_camera(last).write.mode("overwrite").parquet(f"{p.output}/camera")


if __name__ == "__main__":
    main()

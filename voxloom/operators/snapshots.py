"""Maps as they stood after chosen frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.pixels import single
from voxloom.operators.fusion import finalize, merge
from voxloom.operators.selection import snapshot_frames
from voxloom.operators.semantics import AGREEMENT, CONFIDENCE


def map_snapshots(frame_partials: DataFrame, frames: list[int], frame: str = "frame_idx") -> DataFrame:
    """The voxel map after each of ``frames`` (rising), keyed by snapshot_frame.

    Partials of the frames between two snapshots are added up first, so what a
    snapshot re-adds is one row for each voxel, label and earlier snapshot, not
    for each frame.
    """
    if not frames:
        raise ValueError("there are no snapshot frames")
    ends = F.array(*[F.lit(f) for f in frames])
    first_end = F.array_min(F.filter(ends, lambda e: e >= F.col(frame)))
    binned = merge(frame_partials.withColumn("__end", first_end).filter("__end is not null").drop(frame), by=["__end"])
    later = F.explode(F.filter(ends, lambda e: e >= F.col("__end"))).alias("snapshot_frame")
    spread = binned.select("*", later).drop("__end")
    return finalize(merge(spread, by=["snapshot_frame"]), by=["snapshot_frame"])


def whole_snapshots(frame_partials: DataFrame, every: int = 5, frame: str = "frame_idx") -> DataFrame:
    """``map_snapshots`` over every frame there is: frames count from the
    table's own first one, and the last one is always exported."""
    first, last = frame_partials.agg(F.min(frame), F.max(frame)).first()
    if first is None:
        raise ValueError("there are no frames")
    counted = frame_partials.withColumn(frame, (F.col(frame) - F.lit(first)).cast("int"))
    return map_snapshots(counted, snapshot_frames(last - first, every), frame)


def snapshot_metrics(snapshots: DataFrame, least_agreement: float = AGREEMENT, least_confidence: float = CONFIDENCE) -> DataFrame:
    """Voxels and the share that the thresholds call unknown, by snapshot."""
    low = (F.col("semantic_agreement") < single(least_agreement)) | (F.col("mean_model_confidence") < single(least_confidence))
    n, unknown = F.count("*"), F.sum(low.cast("bigint"))
    share = F.when(n > 0, unknown.cast("double") / n.cast("double")).otherwise(0.0)
    return snapshots.groupBy("snapshot_frame").agg(n.alias("voxels"), unknown.alias("unknown_voxels"), share.alias("unknown_ratio"))

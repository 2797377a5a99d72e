"""The incremental voxel map as a streaming aggregation.

Frames arrive as files; the state is the sums for each (snapshot, voxel, label),
where a frame belongs to the snapshot that ends its interval, so maps by frame
are exact however frames fall into micro-batches.  Only sums that change are
written, as a table of changes; a map is the latest sums of the snapshots up to
a frame, added up.  The second level (label of the largest sum) runs as a batch
plan, since one stream cannot chain two aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from voxloom.operators.fusion import KEYS, finalize, merge, partials
from voxloom.sinks.maps import write_snapshot

FRAME = "frame_idx"


def write_frames(obs: DataFrame, folder: str, frame: str = FRAME) -> list[int]:
    """One Parquet folder for each frame, in order; returns the frames."""
    obs.repartition(frame).write.mode("overwrite").partitionBy(frame).parquet(folder)
    return [r[0] for r in obs.select(frame).distinct().orderBy(frame).collect()]


def changes_of(snapshots: str) -> str:
    return f"{snapshots.rstrip('/')}_changes"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path, in whatever store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def latest(changes: DataFrame) -> DataFrame:
    """The sums of each (snapshot, voxel, label) as they were last written."""
    keys = ["snapshot_frame", *KEYS, "label"]
    sums = [c for c in changes.columns if c not in (*keys, "batch")]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*sums), F.col("batch")).alias("s"))
    return newest.select(*keys, "s.*")


def stream_map(
    spark: SparkSession, frames: str, schema, size: float, checkpoint: str, snapshots: str, every: int = 5, files_per_batch: int = 1, seen=None
) -> list[int]:
    """Replays the frames of ``write_frames`` through the stateful aggregation
    until none is left; ``schema`` is that of the observations.

    The map after each ``every``-th frame is written as a partition of the
    snapshot table once a later frame has come, and again should an earlier
    frame come after that; the map after the last frame always.  Restarting with
    the same checkpoint goes on where it stopped.  Returns the snapshots in the
    order they were written.
    """
    changes, written = changes_of(snapshots), []
    known: set[int] = set()
    if exists(spark, changes):
        known.update(r[0] for r in spark.read.parquet(changes).select("snapshot_frame").distinct().collect())
    typed = StructType([f for f in schema.fields if f.name != FRAME]).add(FRAME, IntegerType())
    source = spark.readStream.schema(typed).option("maxFilesPerTrigger", files_per_batch).parquet(frames)
    ends = (F.ceil(F.col(FRAME) / every) * every).cast("int").alias("snapshot_frame")
    state = partials(source.select("*", ends), size, by=["snapshot_frame"], seen=seen)

    def export(end: int, name: int) -> None:
        upto = spark.read.parquet(changes).filter(F.col("snapshot_frame") <= end)
        write_snapshot(finalize(merge(latest(upto))), snapshots, name)
        written.append(name)

    def emit(parts: DataFrame, batch: int) -> None:
        own = f"{changes}/batch={batch}"
        parts.write.mode("overwrite").parquet(own)
        touched = {r[0] for r in spark.read.parquet(own).select("snapshot_frame").distinct().collect()}
        if not touched:
            return
        before = max(known, default=None)
        known.update(touched)
        # ended by a later frame now, or changed after they had ended
        for end in sorted(known):
            if end < max(known) and (end >= min(touched) or end == before):
                export(end, end)

    query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(emit).trigger(availableNow=True)
    batches = query.start()
    batches.awaitTermination()
    if any(p["numInputRows"] for p in batches.recentProgress):
        last = spark.read.parquet(frames).agg(F.max(FRAME)).first()[0]
        export(max(known), last)
    return written


def last_map(spark: SparkSession, snapshots: str) -> DataFrame:
    """The map of all frames that ``stream_map`` has seen."""
    return finalize(merge(latest(spark.read.parquet(changes_of(snapshots)))))

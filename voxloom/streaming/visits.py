"""Keyed state of one's own: how often and in how many frames a voxel was seen.

Built-in aggregations cannot count distinct frames in a stream; a state for each
voxel can, as frames arrive in rising order: the last frame, frames and
observations, three numbers a voxel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructType

from voxloom.functions.checks import positive
from voxloom.functions.pixels import voxel_index
from voxloom.operators.fusion import KEYS
from voxloom.streaming.mapping import FRAME

VISITS = "ix bigint, iy bigint, iz bigint, frames bigint, observations bigint"


def count_visits(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The counts of one voxel after a micro-batch.  A frame that comes again is
    not counted again as long as no later one came between."""
    last, frames, observations = state.get if state.exists else (None, 0, 0)
    counts = pd.concat([b[FRAME] for b in batches]).value_counts().sort_index()
    for frame, n in counts.items():
        frames += last is None or int(frame) > last
        last = int(frame) if last is None else max(last, int(frame))
        observations += int(n)
    state.update((last, frames, observations))
    yield pd.DataFrame([(*key, frames, observations)], columns=[*KEYS, "frames", "observations"])


def stream_visits(spark: SparkSession, frames: str, schema, size: float, checkpoint: str, changes: str, files_per_batch: int = 1) -> None:
    """Replays the frames of ``write_frames`` and writes the counts that change,
    a partition a micro-batch."""
    size = positive("the voxel size", size)
    typed = StructType([f for f in schema.fields if f.name != FRAME]).add(FRAME, IntegerType())
    source = spark.readStream.schema(typed).option("maxFilesPerTrigger", files_per_batch).parquet(frames)
    cells = source.select(*[voxel_index(F.col(c), size).alias(k) for c, k in zip("xyz", KEYS, strict=True)], FRAME)
    counted = cells.groupBy(*KEYS).applyInPandasWithState(
        count_visits, VISITS, "last int, frames bigint, observations bigint", "update", GroupStateTimeout.NoTimeout
    )

    def emit(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{changes}/batch={batch}")

    writing = counted.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(emit).trigger(availableNow=True)
    writing.start().awaitTermination()


def visits(spark: SparkSession, changes: str) -> DataFrame:
    """The counts of each voxel as they were last written."""
    newest = spark.read.parquet(changes).groupBy(*KEYS).agg(F.max_by(F.struct("frames", "observations"), F.col("batch")).alias("s"))
    return newest.select(*KEYS, "s.*")

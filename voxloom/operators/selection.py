"""Which rows of an ordered relation are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import saved


def numbered(df: DataFrame, order: list[Column | str], name: str = "rec_idx", by: list[str] | None = None) -> DataFrame:
    """Adds the place of each row from 0, in each group of ``by``.

    With ``by`` it is a window over each group.  Without, rows are dealt by
    range and written once with the number of their range; both the places
    inside a range and the sizes of the ranges before come from that table (a
    second evaluation would sample other ranges), so no single task takes all
    rows.  ``order`` has to tell all rows apart for places to be stable.
    """
    if by:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))
    return ranged_places(df, [], order, name)


def ranged_places(df: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``numbered`` by ranges of ``by`` and ``order``: groups may be of any size."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(df.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    # within a range partition a window is local; partition sizes make places global
    local = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)))
    sizes = dealt.groupBy("__part", *by).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    keys = {c: f"__of{k}" for k, c in enumerate(by)}
    starts = sizes.select(F.col("__part").alias("__p"), *[F.col(c).alias(n) for c, n in keys.items()], F.coalesce(before, F.lit(0)).alias("__start"))
    same = [F.col("__part") == F.col("__p"), *[F.col(c).eqNullSafe(F.col(n)) for c, n in keys.items()]]
    placed = local.join(starts, same).withColumn(name, (F.col("__start") + F.col("__at") - 1).cast("bigint"))
    return placed.drop(*keys.values(), "__p", "__part", "__at", "__start")


def every_nth(df: DataFrame, step: int, index: str = "rec_idx") -> DataFrame:
    """Rows 0, step, 2 * step, ... of a numbered relation."""
    if step < 1:
        raise ValueError("the step is at least 1")
    return df.filter(F.col(index) % step == 0)


def middle_row(df: DataFrame, index: str = "rec_idx", by: list[str] | None = None) -> DataFrame:
    """The row at half the count, rounded down, of each group."""
    if by:
        counts = df.groupBy(*by).agg(F.floor(F.count("*") / 2).alias("__mid"))
        return df.join(counts, by).filter(F.col(index) == F.col("__mid")).drop("__mid")
    counts = df.agg(F.floor(F.count("*") / 2).alias("__mid"))
    return df.join(counts, F.col(index) == F.col("__mid")).drop("__mid")


def snapshot_frames(last_frame: int, every: int = 5) -> list[int]:
    """Frames whose map is exported: each ``every``-th, and always the last."""
    if last_frame < 0:
        return []
    frames = list(range(0, last_frame + 1, every))
    return frames if frames[-1] == last_frame else [*frames, last_frame]

"""Places and percentiles over ranges, on rows with more than their order."""

import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import association as assoc
from voxloom.operators import metrics, selection
from voxloom.session import saved


def test_places_of_rows_with_other_columns(spark):
    frame = spark.range(60_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("text"), ((F.col("id") * 7919) % 60_013).cast("double").alias("t"))
    found = selection.numbered(frame, ["t", "id"]).select("t", "text", "rec_idx").collect()
    assert [r["rec_idx"] for r in sorted(found, key=lambda r: r["t"])] == list(range(60_000))


def test_places_of_nothing(spark):
    assert selection.numbered(spark.range(0).withColumn("x", F.lit(1)), ["id"]).collect() == []


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.98, 1.0])
def test_percentile(spark, q):
    rng = random.Random(3)
    values = [float(rng.randrange(50)) for _ in range(400)] + [7.0] * 300
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    ordered = sorted(values)
    at = q * (len(ordered) - 1)
    low, high = ordered[int(at)], ordered[min(int(at) + 1, len(ordered) - 1)]
    assert metrics.percentile(frame, "v", q).first()[0] == pytest.approx(low + (high - low) * (at - int(at)))
    assert metrics.percentile(frame.limit(0), "v", q).first()[0] is None


def test_equal_left_rows_are_answered_each(spark):
    left = spark.createDataFrame([("s", 1, 1.0), ("s", 1, 1.0), ("s", 2, 9.0)], "seq_id string, depth_idx bigint, depth_t double")
    right = spark.createDataFrame([("s", 0, 0.9), ("s", 1, 1.05)], "seq_id string, pose_idx bigint, pose_t double")
    found = assoc.nearest_asof(left, right, "seq_id", "depth_idx", "depth_t", "pose_idx", "pose_t", 0.5, "none").collect()
    assert [(r["depth_idx"], r["pose_idx"]) for r in found] == [(1, 1), (1, 1)]


def test_a_chain_ends_exactly(spark):
    """Rising differences: each round takes one pair, the rest goes at once."""
    rows, at = [], 0.0
    for k in range(12):
        at += 1 + k / 100
        rows.append(("s", k // 2 + k % 2, k // 2, 1 + k / 100))
    pairs = saved(spark.createDataFrame(rows, "seq_id string, rgb_idx bigint, depth_idx bigint, difference double"))
    args = ("seq_id", "rgb_idx", "depth_idx", "difference")
    matched = lambda frame: sorted(map(tuple, frame.collect()))
    greedy = matched(assoc.match_greedy(pairs, *args))
    for rounds in (0, 1, 2, 50):
        assert matched(assoc.match_mutual(pairs, *args, saved, rounds)) == greedy

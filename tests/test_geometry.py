import math

import pytest
from pyspark.sql import functions as F

from voxloom.functions import pixels
from voxloom.operators import geometry, selection

POSE = "frame_idx int, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
HALF = math.sqrt(0.5)


def world(spark, point, pose):
    points = spark.createDataFrame([(0, *map(float, point))], "frame_idx int, x double, y double, z double")
    poses = spark.createDataFrame([(0, *map(float, pose))], POSE)
    return tuple(geometry.to_world(points, geometry.pose_matrices(poses, ["frame_idx"]), ["frame_idx"]).first()[1:])


def test_depth_limits(spark):
    raw = spark.createDataFrame([(k,) for k in (0, 499, 500, 25000, 25001)], "raw int")
    kept = raw.withColumn("d", pixels.depth_to_metres(F.col("raw"))).filter(pixels.valid_depth(F.col("d")))
    assert [r[0] for r in kept.collect()] == [500, 25000]


def test_not_finite_depth(spark):
    rows = spark.createDataFrame([(math.nan,), (math.inf,), (1.0,)], "d float")
    assert rows.filter(pixels.valid_depth(F.col("d"))).count() == 1


def test_backproject(spark):
    row = spark.createDataFrame([(240, 320, 1.0)], "v int, u int, depth float")
    x, y, z = geometry.backproject(row, 4).select("x", "y", "z").first()
    assert (x, y, z) == (0.5 / 525, 0.5 / 525, 1.0)


def test_stride(spark):
    image = spark.createDataFrame([(1, [1.0] * 16)], "k int, depths array<float>")
    found = geometry.backproject(geometry.image_pixels(image, "depths", 4, "depth"), 2, carry=["k"])
    assert sorted((r["v"], r["u"]) for r in found.collect()) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    with pytest.raises(ValueError):
        pixels.on_stride(F.col("v"), F.col("u"), 0)


def test_poses(spark):
    assert world(spark, (0, 0, 0), (1, 2, 3, 0, 0, 0, 1)) == (1, 2, 3)
    assert world(spark, (1, 0, 0), (0, 0, 0, 0, 0, HALF, HALF)) == pytest.approx((0, 1, 0), abs=1e-12)
    assert world(spark, (1, 2, 3), (4, 5, 6, 0, 0, 0, 2)) == (5, 7, 9)
    with pytest.raises(Exception, match="must not be zero"):
        world(spark, (1, 0, 0), (0, 0, 0, 0, 0, 0, 0))
    with pytest.raises(Exception, match="must be finite"):
        world(spark, (math.nan, 0, 0), (0, 0, 0, 0, 0, 0, 1))


def test_camera(spark):
    points = spark.createDataFrame([(0.0, 0.0, 0.0), (2.0, 0.0, 0.0)], "x double, y double, z double")
    found = geometry.fixed_camera(points).first().asDict()
    assert (found["center_x"], found["center_y"], found["near_clip"], found["far_clip"]) == (1, 0, 1, 5.5)
    eye = [found[f"eye_{c}"] - found[f"center_{c}"] for c in "xyz"]
    assert math.hypot(*eye) == pytest.approx(3.0)
    assert (found["up_x"], found["up_y"], found["up_z"]) == (0, 0, 1)
    one = geometry.fixed_camera(points.limit(1)).first()
    assert one["far_clip"] == pytest.approx(0.55)


def test_bounds(spark):
    points = spark.createDataFrame([(0.0, 1.0, 5.0), (2.0, 3.0, 7.0)], "x double, y double, z double")
    assert geometry.bounds(points).first().asDict()["mean_z"] == 6.0


def test_selection(spark):
    rows = spark.range(1000).withColumn("t", F.col("id") * 7 % 1000)
    numbered = selection.numbered(rows, ["t"])
    assert numbered.filter("rec_idx <> t").count() == 0
    assert selection.every_nth(numbered, 20).count() == 50
    assert selection.middle_row(numbered).first()["t"] == 500
    by = selection.numbered(rows.withColumn("k", F.col("id") % 3), ["t"], by=["k"])
    assert by.agg(F.max("rec_idx")).first()[0] == 333
    assert selection.middle_row(by, by=["k"]).count() == 3
    assert selection.numbered(rows.limit(0), ["t"]).count() == 0
    assert selection.snapshot_frames(7) == [0, 5, 7] and selection.snapshot_frames(5) == [0, 5] and selection.snapshot_frames(-1) == []

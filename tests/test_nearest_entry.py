"""The nearest entry at any distance, keyed state over batches, and settings."""

import random

import pytest

from voxloom import replay
from voxloom.operators import association as assoc
from voxloom.sinks import maps
from voxloom.streaming import mapping, visits


def test_nearest_entry(spark):
    rng = random.Random(4)
    left = [("s", k, float(rng.randrange(40))) for k in range(30)] + [("none", 99, 1.0)]
    right = [("s", k, float(rng.randrange(40))) for k in range(12)] + [("t", 0, 1.0)]
    one = spark.createDataFrame(left, "seq_id string, a bigint, ta double")
    two = spark.createDataFrame(right, "seq_id string, b bigint, tb double")
    found = sorted((r["a"], r["b"], r["gap"]) for r in assoc.nearest_entry(one, two, "seq_id", "a", "ta", "b", "tb").collect())
    wanted = []
    for _, k, t in left[:-1]:
        gap, idx = min((abs(t - u), j) for s, j, u in right if s == "s")
        wanted.append((k, idx, gap))
    assert found == sorted(wanted)


def test_visits_over_batches(spark, tmp_path):
    import os

    rows = [(float(k % 5), 0.0, 0.0, k // 6) for k in range(40)]
    obs = spark.createDataFrame(rows, "x double, y double, z double, frame_idx int")
    folder = str(tmp_path / "frames")
    frames = mapping.write_frames(obs, folder)
    for frame in frames:  # files are taken by age
        own = os.path.join(folder, f"frame_idx={frame}")
        for name in os.listdir(own):
            os.utime(os.path.join(own, name), (1_700_000_000 + frame, 1_700_000_000 + frame))
    for n in (1, 3, 100):
        base = str(tmp_path / f"n{n}")
        visits.stream_visits(spark, folder, obs.schema, 1.0, f"{base}/state", f"{base}/changes", n)
        found = {r["ix"]: (r["frames"], r["observations"]) for r in visits.visits(spark, f"{base}/changes").collect()}
        assert found == {x: (len({f for a, _, _, f in rows if a == x}), sum(a == x for a, *_ in rows)) for x in range(5)}


def test_arrays_lack_pixels(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 5, 0.5), (1, 1, 1, 5, 0.5)], "k int, v int, u int, label bigint, conf float")
    with pytest.raises(Exception, match="lacks pixels"):
        maps.label_arrays(pixels, ["k"]).collect()


def test_layout_and_point_size():
    given = replay.parse_arguments(["--snapshots", "a", "--output", "b", "--layout", "triple", "--point-size", "2"])
    assert (given.layout, given.point_size) == ("triple", 2.0)
    with pytest.raises(SystemExit):
        replay.parse_arguments(["--snapshots", "a", "--output", "b", "--layout", "other"])

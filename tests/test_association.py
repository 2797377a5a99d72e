import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import association as assoc
from voxloom.session import saved

RGB, DEPTH, POSE = "seq_id string, rgb_idx bigint, rgb_t double", "seq_id string, depth_idx bigint, depth_t double", "seq_id string, pose_idx bigint, pose_t double"


def entries(spark, times, schema):
    return spark.createDataFrame([("s", k, float(t)) for k, t in enumerate(times)], schema)


def pairs_of(spark, rgb, depth, width):
    found = assoc.band_join(entries(spark, rgb, RGB), entries(spark, depth, DEPTH), "rgb_t", "depth_t", width, ["seq_id"])
    return found.withColumn("difference", assoc.time_difference(F.col("rgb_t"), F.col("depth_t")))


def matched(frame):
    return sorted((r["rgb_idx"], r["depth_idx"]) for r in frame.collect())


def test_crossing_candidates(spark):
    pairs = pairs_of(spark, [0.00, 0.03], [0.01, 0.02], 0.03)
    assert matched(assoc.match_greedy(pairs, "seq_id", "rgb_idx", "depth_idx", "difference")) == [(0, 0), (1, 1)]


def test_greedy_is_not_maximum(spark):
    rgb, depth = [0.000, 0.020], [0.015, 0.045]
    pairs = pairs_of(spark, rgb, depth, 0.03)
    assert matched(assoc.match_greedy(pairs, "seq_id", "rgb_idx", "depth_idx", "difference")) == [(1, 0)]
    ordered = assoc.match_ordered(entries(spark, rgb, RGB), entries(spark, depth, DEPTH), "seq_id", "rgb_idx", "rgb_t", "depth_idx", "depth_t", 0.03)
    assert matched(ordered) == [(0, 0), (1, 1)]


def test_mutual_equals_greedy(spark):
    rng = random.Random(5)
    rgb, depth = ([rng.randrange(60) for _ in range(40)] for _ in range(2))
    pairs = saved(pairs_of(spark, rgb, depth, 3))
    greedy = matched(assoc.match_greedy(pairs, "seq_id", "rgb_idx", "depth_idx", "difference"))
    assert greedy and greedy == matched(assoc.match_mutual(pairs, "seq_id", "rgb_idx", "depth_idx", "difference", saved))
    assert matched(assoc.match_mutual(pairs.limit(0), "seq_id", "rgb_idx", "depth_idx", "difference", saved)) == []


@pytest.mark.parametrize("width", [0.0, 0.1, 1.0])
def test_band_join_finds_all_pairs(spark, width):
    rng = random.Random(9)
    rgb, depth = ([rng.randrange(100) / 10 for _ in range(60)] for _ in range(2))
    wanted = sorted((i, j) for (i, a), (j, b) in itertools.product(enumerate(rgb), enumerate(depth)) if abs(a - b) <= width)
    assert matched(pairs_of(spark, rgb, depth, width)) == wanted


def test_nulls_and_nan_match_nothing(spark):
    one = spark.createDataFrame([("s", 0, None), ("s", 1, float("nan")), ("s", 2, 1.0)], RGB)
    assert matched(assoc.band_join(one, entries(spark, [1.0], DEPTH), "rgb_t", "depth_t", 1.0, ["seq_id"])) == [(2, 0)]
    with pytest.raises(ValueError):
        assoc.band_join(one, one, "rgb_t", "rgb_t", float("nan"))


def nearest(spark, depth, poses, tolerance=0.02, clip="file"):
    found = assoc.nearest_asof(entries(spark, depth, DEPTH), entries(spark, poses, POSE), "seq_id", "depth_idx", "depth_t", "pose_idx", "pose_t", tolerance, clip)
    return sorted((r["depth_idx"], r["pose_idx"]) for r in found.collect())


def test_nearest_pose(spark):
    assert nearest(spark, [1.0], [0.984375, 1.015625]) == [(0, 0)]
    assert nearest(spark, [0.5, 1.0, 2.5], [0.99, 1.0, 2.0]) == [(1, 1)]
    assert nearest(spark, [1.03], [1.0, 2.0]) == []
    assert nearest(spark, [1.0, 1.001], [1.0, 2.0]) == [(0, 0), (1, 0)]
    assert nearest(spark, [0.995], [1.0, 2.0]) == []
    assert nearest(spark, [0.995], [1.0, 2.0], clip="none") == [(0, 0)]
    assert nearest(spark, [1.5], [2.0, 1.5, 1.0], clip="time") == [(0, 1)] and nearest(spark, [1.5], [2.0, 1.5, 1.0]) == []


def best_ordered(a, b, width):
    table = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = [(0, 0.0)]
            if i:
                options.append(table[i - 1, j])
            if j:
                options.append(table[i, j - 1])
            if i and j and abs(a[i - 1] - b[j - 1]) <= width:
                n, e = table[i - 1, j - 1]
                options.append((n + 1, e - abs(a[i - 1] - b[j - 1])))
            table[i, j] = max(options)
    return table[len(a), len(b)]


def test_ordered_matching_is_optimal():
    rng = random.Random(11)
    for _ in range(200):
        a, b = (np.array(sorted(rng.randrange(40) for _ in range(rng.randrange(12))), float) for _ in range(2))
        width = rng.randrange(6)
        pairs = assoc.ordered_matching(a, b, width)
        assert all(p < q and r < s for (p, r), (q, s) in itertools.pairwise(pairs))
        assert all(abs(a[i] - b[j]) <= width for i, j in pairs)
        n, error = best_ordered(a.tolist(), b.tolist(), width)
        assert (len(pairs), sum(abs(a[i] - b[j]) for i, j in pairs)) == (n, -error)


def test_statistics_and_order(spark):
    pairs = pairs_of(spark, [0.0, 2.0], [1.0, 2.0], 1.0)
    assert assoc.time_statistics(pairs, "difference").first().asDict() == {"n": 3, "mean": 2 / 3, "max": 1.0, "median": 1.0}
    ordered = assoc.in_depth_order(pairs, "seq_id", "depth_t", "difference", "rgb_idx", "depth_idx").orderBy("rec_idx").collect()
    assert [(r["rgb_idx"], r["depth_idx"]) for r in ordered] == [(0, 0), (1, 0), (1, 1)]

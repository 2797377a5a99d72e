import math
import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import fusion

SCHEMA = "x float, y float, z float, r float, g float, b float, label bigint, conf float, seq int"
SIX = [
    (0.001, 0.001, 0.001, 1.0, 0.0, 0.0, 3, 0.80, 0),
    (0.004, 0.003, 0.002, 0.0, 1.0, 0.0, 3, 0.70, 1),
    (0.008, 0.002, 0.005, 0.0, 0.0, 1.0, 7, 0.40, 2),
    (0.011, 0.001, 0.001, 1.0, 1.0, 1.0, 12, 0.90, 3),
    (0.018, 0.004, 0.003, 0.5, 0.5, 0.5, 12, 0.60, 4),
    (-0.001, 0.002, 0.002, 1.0, 1.0, 0.0, 5, 0.75, 5),
]
EXPECTED = {
    (-1, 0, 0): (-0.001, 0.002, 0.002, 1, 1, 0, 5, 1.0, 0.75, 1),
    (0, 0, 0): (0.00433333, 0.002, 0.00266667, 1 / 3, 1 / 3, 1 / 3, 3, 1.5 / 1.9, 1.9 / 3, 3),
    (1, 0, 0): (0.0145, 0.0025, 0.002, 0.75, 0.75, 0.75, 12, 1.0, 0.75, 2),
}


def rows(spark, points):
    return spark.createDataFrame(points, SCHEMA)


def as_map(frame):
    return {tuple(r[:3]): tuple(r[3:]) for r in frame.collect()}


def close(found, wanted):
    assert found.keys() == wanted.keys()
    for k in wanted:
        assert found[k] == pytest.approx(wanted[k], abs=1e-6), k


def one_voxel(*pairs):
    return [(0.1, 0.1, 0.1, 0.0, 0.0, 0.0, label, conf, k) for k, (label, conf) in enumerate(pairs)]


def test_six_points(spark):
    close(as_map(fusion.voxel_map(rows(spark, SIX), 0.01)), EXPECTED)


def test_two_updates_are_one(spark):
    parts = [fusion.partials(rows(spark, x), 0.01) for x in (SIX[:3], SIX[3:])]
    close(as_map(fusion.finalize(fusion.merge(*parts))), EXPECTED)


def test_worked_example(spark):
    found = as_map(fusion.voxel_map(rows(spark, one_voxel((2, 0.8), (2, 0.6), (0, 0.7))), 1.0))[0, 0, 0]
    assert found[6] == 2 and found[7:9] == pytest.approx((1.4 / 2.1, 0.7), abs=1e-6)


@pytest.mark.parametrize("pairs, first, lowest", [(((7, 0.5), (3, 0.5)), 7, 3), (((9, 0.0), (4, 0.0)), 9, 4)])
def test_ties(spark, pairs, first, lowest):
    obs = rows(spark, one_voxel(*pairs))
    seen = as_map(fusion.voxel_map(obs, 1.0, "first_seen", F.col("seq")))[0, 0, 0]
    low = as_map(fusion.voxel_map(obs, 1.0))[0, 0, 0]
    assert (seen[6], low[6]) == (first, lowest)
    assert low[7] == (0.5 if pairs[0][1] else 0.0) and low[9] == 2
    if not pairs[0][1]:
        assert low[8] == 0.0


def test_empty(spark):
    none = rows(spark, [])
    assert fusion.voxel_map(none, 0.01).count() == 0
    with pytest.raises(ValueError):
        fusion.voxel_map(none, 0.01, strict=True)
    merged = fusion.merge(fusion.partials(rows(spark, SIX), 0.01), fusion.partials(none, 0.01))
    close(as_map(fusion.finalize(merged)), EXPECTED)


@pytest.mark.parametrize("size", [0, -1, math.nan, math.inf])
def test_bad_size(spark, size):
    with pytest.raises(ValueError):
        fusion.partials(rows(spark, SIX), size)


@pytest.mark.parametrize("at, value", [(7, 1.01), (7, -0.1), (0, math.nan), (3, math.inf), (7, math.nan)])
def test_bad_observation(spark, at, value):
    bad = list(SIX[0])
    bad[at] = value
    with pytest.raises(Exception, match="must be finite"):
        fusion.checked_observations(rows(spark, [tuple(bad)])).collect()
    assert fusion.checked_observations(rows(spark, SIX)).count() == 6


def test_bad_tie(spark):
    with pytest.raises(ValueError):
        fusion.voxel_map(rows(spark, SIX), 0.01, "first_seen")
    with pytest.raises(ValueError):
        fusion.voxel_map(rows(spark, SIX), 0.01, "other")


def test_any_split_gives_the_same_map(spark):
    rng = random.Random(3)
    points = [
        (*(rng.randrange(-20, 20) / 8 for _ in range(3)), *(rng.randrange(256) / 256 for _ in range(3)), rng.randrange(4), rng.randrange(129) / 128, k)
        for k in range(400)
    ]
    whole = fusion.voxel_map(rows(spark, points), 1.0, "first_seen", F.col("seq"))
    split = [fusion.partials(rows(spark, points[k::3]), 1.0, seen=F.col("seq")) for k in range(3)]
    assert as_map(fusion.finalize(fusion.merge(*split), "first_seen")) == as_map(whole)
    assert sum(v[9] for v in as_map(whole).values()) == len(points)
    assert all(0 <= v[7] <= 1 for v in as_map(whole).values())


def test_downsample(spark):
    found = as_map(fusion.downsample(rows(spark, SIX), 0.01))
    close(found, {k: v[:6] for k, v in EXPECTED.items()})
    assert fusion.voxel_count(fusion.partials(rows(spark, SIX), 0.01)).first()[0] == 3

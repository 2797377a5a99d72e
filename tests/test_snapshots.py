"""Snapshots over every frame there is."""

import pytest

from voxloom.operators import fusion, snapshots
from voxloom.plans import catalogue
from voxloom.plans.standins import observations

COUNTS = "WITH " + catalogue.OBS + """, e AS (SELECT min(frame_idx) AS lo, max(frame_idx) AS hi FROM o),
f AS (SELECT DISTINCT least(k * 20, hi - lo) AS frame FROM e, range(100) AS r(k))
SELECT frame, count(DISTINCT (ix, iy, iz)), count(*) FROM f, e, o WHERE o.frame_idx - lo <= frame GROUP BY frame ORDER BY frame"""


def test_every_frame_is_in_a_snapshot(spark, sf_dir, duck):
    obs = observations(spark, sf_dir)
    found = snapshots.whole_snapshots(fusion.partials(obs, catalogue.SIZE, by=["frame_idx"]), 20).toPandas()
    mine = found.groupby("snapshot_frame")["observation_count"].agg(["size", "sum"])
    assert [(int(k), int(n), int(s)) for k, n, s in mine.itertuples()] == duck.cursor().sql(COUNTS).fetchall()
    assert mine["sum"].iloc[-1] == obs.count() and mine.index[0] == 0


def test_no_frames(spark, sf_dir):
    none = fusion.partials(observations(spark, sf_dir).filter("false"), catalogue.SIZE, by=["frame_idx"])
    with pytest.raises(ValueError):
        snapshots.whole_snapshots(none)

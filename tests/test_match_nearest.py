"""The greedy matching from neighbours in time, in ranges, against its candidates."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import association as assoc
from voxloom.plans import catalogue

KEYS = ("seq_id", "rgb_idx", "depth_idx", "difference")
SCHEMAS = ("seq_id string, rgb_idx bigint, rgb_t {0}", "seq_id string, depth_idx bigint, depth_t {0}")


def matched(frame):
    return sorted(tuple(r[k] for k in KEYS) for r in frame.collect())


def both_ways(spark, rgb, depth, kind, width, rows):
    one, two = (spark.createDataFrame(x, s.format(kind)) for x, s in zip((rgb, depth), SCHEMAS, strict=True))
    pairs = assoc.band_join(one, two, "rgb_t", "depth_t", width, ["seq_id"]).withColumn("difference", assoc.time_difference(F.col("rgb_t"), F.col("depth_t")))
    found = assoc.match_nearest(one, two, "seq_id", "rgb_idx", "rgb_t", "depth_idx", "depth_t", width, rows)
    return matched(found), matched(assoc.match_greedy(pairs, *KEYS))


@pytest.mark.parametrize("rows", [7, 40, 1000])
@pytest.mark.parametrize(("kind", "start", "step", "width"), [("bigint", 0, 1, 3), ("double", 1.3e9, 0.01, 0.03), ("bigint", 0, 1, 0), ("double", 0.0, 0.1, 0.25)])
def test_ranges_give_the_greedy_pairs(spark, kind, start, step, width, rows):
    rng = random.Random(rows)
    entries = lambda n: [(s, k, start + step * rng.randrange(span)) for s, span in (("a", 40), ("b", 400)) for k in rng.sample(range(10**15, 10**15 + n), n)]
    found, wanted = both_ways(spark, entries(60), [*entries(50), ("c", 1, start)], kind, width, rows)
    assert found == wanted and len(found) > 20


def test_rising_differences_across_ranges(spark):
    """Each pair stands only if the next one does not: the last round decides."""
    t = [k * 1000 - k * k for k in range(60)]
    found, wanted = both_ways(spark, [("s", k, x) for k, x in enumerate(t[::2])], [("s", k, x) for k, x in enumerate(t[1::2])], "bigint", 1000, 5)
    assert found == wanted and len(found) == 30


def test_odd_entries(spark):
    nan = float("nan")
    rgb, depth = [("s", 1, 5.0), ("s", 1, 9.0), ("s", 2, nan), ("s", 3, None), (None, 4, 5.0)], [("s", 1, 5.5), ("s", 2, 9.25), ("s", 3, nan), (None, 4, 5.0)]
    for one in (rgb, rgb[1:]):  # an index that repeats, and none
        found, wanted = both_ways(spark, one, depth, "double", 1.0, 2)
        assert found == wanted == [("s", 1, 2, 0.25)]
    assert both_ways(spark, rgb, [], "double", 1.0, 2) == ([], [])


def test_repeated_entries_count_once(spark, monkeypatch):
    rgb, depth = [("s", k, 10 + k) for k in (1, 1, 2, 1, 5)], [("s", k, 11 + k) for k in (1, 2, 2, 9)]
    found, wanted = both_ways(spark, rgb, depth, "bigint", 3, 2)
    assert found == wanted == [("s", 1, 2, 2), ("s", 2, 1, 0)]
    one, two = (spark.createDataFrame(x, s.format("bigint")) for x, s in zip((rgb, depth), SCHEMAS, strict=True))
    monkeypatch.setattr(assoc, "band_join", lambda *_: pytest.fail("candidates are joined"))
    assert matched(assoc.match_nearest(one, two, "seq_id", "rgb_idx", "rgb_t", "depth_idx", "depth_t", 3)) == wanted


def test_the_query_makes_no_candidates(spark, tmp_path, monkeypatch):
    """1,500 entries a side at one moment: 2,250,000 candidates, 1,500 pairs."""
    at = datetime.datetime(2024, 1, 1, 12)
    rows = [(2 * k + side, at, kind) for k in range(1500) for side, kind in enumerate(("view", "click"))]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(assoc, "band_join", lambda *_: pytest.fail("candidates are joined"))
    found = sorted(map(tuple, catalogue.assoc_greedy(spark, str(tmp_path)).collect()))
    assert found == [(2 * k, 2 * k + 1, 0) for k in range(1500)]


def test_places_of_sequences_over_ranges(spark):
    """Sequences of one row, of many and of all ranges; no task sorts a sequence."""
    rng = random.Random(2)
    rows = [(s, rng.randrange(50), float(rng.randrange(3)), k, k) for s, n in (("a", 1), ("b", 900), (None, 3), ("c", 40)) for k in range(n)]
    pairs = spark.createDataFrame(rows, "seq_id string, depth_t bigint, difference double, rgb_idx bigint, depth_idx bigint")
    ordered = assoc.in_depth_order(pairs, "seq_id", "depth_t", "difference", "rgb_idx", "depth_idx")
    assert ordered.columns == [*pairs.columns, "rec_idx"] and ordered.schema["rec_idx"].dataType.simpleString() == "int"
    found = sorted((r["seq_id"] or "", *r[1:5], r["rec_idx"]) for r in ordered.collect())
    wanted, last = [], {}
    for row in sorted((s or "", *x) for s, *x in rows):
        last[row[0]] = last.get(row[0], -1) + 1
        wanted.append((*row, last[row[0]]))
    assert found == wanted
    plan = ordered._jdf.queryExecution().analyzed().toString()
    assert "row_number() windowspecdefinition(__part" in plan and "row_number() windowspecdefinition(seq_id" not in plan

"""The nearest entry at any distance, in ranges of time."""

import random
import re

from voxloom.operators import association as assoc


def test_nearest_entry_over_ranges(spark):
    """Ranges without any right row, one moment over many ranges, and rows without a time."""
    rng = random.Random(8)
    left = [("s", k, rng.choice((500, 500, rng.randrange(1000)))) for k in range(300)] + [("s", 900, None), ("u", 901, 3), ("none", 902, 1)]
    right = [("s", 50, 490), ("s", 51, 510), ("s", 40, 510), ("s", 7, None), ("s", 60, 2000), ("t", 1, 5), ("u", 3, None), ("u", 2, None)]
    one = spark.createDataFrame(left, "seq_id string, a bigint, ta bigint")
    two = spark.createDataFrame(right, "seq_id string, b bigint, tb bigint")
    frame = assoc.nearest_entry(one, two, "seq_id", "a", "ta", "b", "tb")
    wanted = []
    for s, k, t in left[:300]:
        gap, idx = min((abs(t - u), j) for q, j, u in right if q == s and u is not None)
        wanted.append((s, k, idx, gap))
    key = lambda r: r[1]
    assert sorted(map(tuple, frame.collect()), key=key) == [*sorted(wanted, key=key), ("s", 900, 7, None), ("u", 901, 2, None)]
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan  # would be read again for each row
    assert set(re.findall(r"\(__here#\d+, true\) windowspecdefinition\((\w+)#", plan)) == {"__part"}  # not a whole sequence

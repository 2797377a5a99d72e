"""Top-k search over very large components."""

import pytest
from test_kdsearch import brute

from voxloom.llm import kdsearch

ROWS = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)]
ROWS += [(100, [2.0**42, 2.0, 0.5]), (101, [-(2.0**20), 3.0, 1.0]), (102, [3.0, 2.0**44, -1.0])]


@pytest.mark.parametrize("shard_rows", [5, 5000])
def test_large_components_take_part(spark, shard_rows):
    frame = spark.createDataFrame(ROWS, "vec_id long, embedding array<double>")
    found = sorted(map(tuple, kdsearch.top_k(frame, 5, 50, scale=1, shard_rows=shard_rows).collect()))
    assert found == brute(ROWS, 5, 50, scale=1)
    assert {r[0] for r in found} == {0, 50, 100} and {100, 102} <= {r[2] for r in found}


def test_beyond_64_bits_is_an_error(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        kdsearch.top_k(frame).collect()

"""KD-tree search against brute force."""

import numpy as np
import pytest
from conftest import same_rows

from voxloom.llm import catalogue, kdsearch


def brute(rows, k, every, scale=256):
    kept = [(i, np.floor(np.array(v, float) * scale).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for i, q in kept:
        if i % every == 0:
            scores = sorted((-int(q @ v), j) for j, v in kept if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(set(out))


@pytest.mark.parametrize("shard_rows", [7, 5000])
def test_exact(spark, shard_rows):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.integers(-3, 4, 4) / 2).tolist()) for k in range(120)]  # many ties
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (None, [1.0] * 4), (250, [1.0, 2.0]), (204, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = kdsearch.top_k(frame, 5, 10, shard_rows=shard_rows).collect()
    assert sorted(map(tuple, found)) == brute(rows, 5, 10)


def test_tree_has_tight_boxes():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-100, 100, (1000, 6))
    order, ranges, children, boxes = kdsearch.build(vectors, 16)
    assert sorted(order) == list(range(1000))
    for (a, b), (left, right), (low, high) in zip(ranges, children, boxes, strict=True):
        own = vectors[order[a:b]]
        assert (own.min(0) == low).all() and (own.max(0) == high).all()
        if left >= 0:
            assert ranges[left][0] == a and ranges[left][1] == ranges[right][0] and ranges[right][1] == b
        else:
            assert b - a <= 16
    same, *_ = kdsearch.build(np.ones((500, 3), int), 16)
    assert len(same) == 500


def test_fewer_candidates_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, kdsearch.top_k(frame).collect())) == [(0, 1, 1, 256 * 512), (0, 2, 1, 256 * 512)]
    assert kdsearch.top_k(frame.limit(0)).count() == 0
    assert kdsearch.top_k(frame.filter("vec_id = 1")).count() == 0


def test_query(spark, sf_dir, duck):
    assert same_rows(catalogue.op6_top_k(spark, sf_dir), catalogue.oracle_sql()["op6_top_k"], duck)

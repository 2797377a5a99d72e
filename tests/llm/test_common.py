"""Shared helpers: blocks, ragged ranges, tables that pass, corpus counts."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom.llm import common, corpuscount, hashing


def test_blocks_keep_rows_and_order():
    texts = ["ab" * k for k in (3, 0, 500, 1, 2, 2, 90, 1)]
    batches = [pa.RecordBatch.from_pydict({"k": [k], "text": [t]}) for k, t in enumerate(texts)]
    found = list(common.blocks([*batches, batches[0].slice(0, 0)], "text", 100))
    assert [t for b in found for t in b["text"].to_pylist()] == texts
    assert all(b["text"].nbytes and (b.num_rows == 1 or sum(map(len, b["text"].to_pylist())) <= 100) for b in found)


def test_byte_buffers_of_slices_and_nulls():
    column = pa.array(["xx", "é", None, "", "abc"]).slice(1)
    data, offsets = common.byte_buffers(column)
    assert data.tobytes() == "éabc".encode() and offsets.tolist() == [0, 2, 2, 2, 5]
    data, offsets = common.byte_buffers(pa.array([], pa.string()))
    assert len(data) == 0 and offsets.tolist() == [0]


def test_ragged():
    assert common.ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert common.ragged(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_passing_tables(spark):
    with common.passing_tables(spark) as result:
        step = common.written(spark.range(3), "step")
        kept = result(step.withColumn("x", F.lit(1)), "kept")
        gone = step.inputFiles()[0]
    assert kept.count() == 3
    assert not os.path.exists(gone.removeprefix("file://"))


def test_span_hashes_depend_on_bytes_only():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 4900, 400))
    ends = starts + 4
    hashes = hashing.span_hashes(data, starts, ends)
    by_bytes = {}
    for a, h in zip(starts, hashes, strict=True):
        assert by_bytes.setdefault(data[a : a + 4].tobytes(), h) == h
    assert len(set(by_bytes.values())) == len(by_bytes)


def test_words_end_at_texts():
    data, offsets = common.byte_buffers(pa.array(["ab", "ab cd", "", " ab\t\n", "é"]))
    hashes, counts = hashing.word_hashes(data, offsets)
    assert counts.tolist() == [1, 2, 0, 1, 1] and hashes[0] == hashes[1] == hashes[3] != hashes[2]


@pytest.mark.parametrize("limit", [20, 1 << 20])
def test_totals_are_corpus_wide(spark, limit):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 5 + 1))) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def keys(data, offsets):
        hashes, _ = hashing.word_hashes(data, offsets)
        return np.unique(hashes, return_counts=True)

    def finish(block, ids, missing, data, offsets, own, total):
        hashes, counts = hashing.word_hashes(data, offsets)
        at = np.searchsorted(own, hashes)
        return pa.table({"doc_id": np.repeat(ids, counts), "n": total[at].astype(np.int64)})

    found = corpuscount.with_totals(frame, keys, finish, "doc_id long, n long", 8, limit).collect()
    wanted = {j: sum(k % 5 >= j for k in range(60)) for j in range(5)}
    assert sorted((r["doc_id"], r["n"]) for r in found) == sorted((k, wanted[j]) for k in range(60) for j in range(k % 5 + 1))

"""Counted anchors spread over all buckets."""

import numpy as np
from pyspark.sql import functions as F

from voxloom.llm import corpuscount, suffixdedup


def test_keys_fill_buckets_evenly(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, "".join(map(chr, rng.integers(97, 123, 3000)))) for k in range(200)]
    sizes = {}

    def kept(rows_, keys, n_buckets, limit):
        found = corpuscount_key_blocks(rows_, keys, n_buckets, limit)
        sizes.update({r["bucket"]: r["n"] for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()})
        return found

    corpuscount_key_blocks = corpuscount.key_blocks
    monkeypatch.setattr(corpuscount, "key_blocks", kept)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffixdedup.cut_repeats(frame, keep_text=False).count() == 200
    assert len(sizes) == 8 and max(sizes.values()) < 1.2 * min(sizes.values())

"""Quality scores: held-out accuracy, folds, statistics, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import catalogue, quality


def test_held_out_accuracy(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = catalogue.op1_quality(spark, sf_dir)
    rows = scores.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows) and rows
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert scores.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0


def test_held_out_labels_are_not_used(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (dict(quality.quality_scores(docs, x).select("doc_id", "score").collect()) for x in (labels, turned))
    assert a == pytest.approx(b)


def test_statistics_by_hand():
    text = "The The A!! 12 é\nx|*"
    data = np.frombuffer(text.encode(), np.uint8)
    x = dict(zip(quality.STATISTICS, quality.statistics(data, np.array([0, 0, len(data)]))[1], strict=True))
    size = len(data) + quality.SMOOTH_BYTES
    assert x["log_bytes"] == np.log1p(len(data)) and x["log_words"] == np.log1p(6)
    for name, n in {"upper": 3, "digit": 2, "bang": 2, "bar": 1, "wide": 2, "line": 1, "symbol": 1, "repeated": 1}.items():
        assert x[name] == pytest.approx(np.sqrt(n / size)), name
    assert x["again"] == pytest.approx(np.sqrt(1 / (6 + quality.SMOOTH_WORDS)))


def test_repetition_does_not_cross_texts():
    data = np.frombuffer(b"a aa a!!", np.uint8)
    both = quality.statistics(data, np.array([0, 3, 3, 8]))
    assert both[1, quality.STATISTICS.index("again")] == 0 and both[2, quality.STATISTICS.index("again")] == 0


def test_model_is_a_discriminant(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(3, 0.5, (300, 2))])
    rows = [(row.tolist(), int(k >= 300)) for k, row in enumerate(x)]
    model = quality.fit(spark.createDataFrame(rows, "x array<double>, label int"), 2, 0.0)
    for k in (0, 1):
        own = x[300 * k : 300 * k + 300]
        cov = np.cov(own.T, bias=True)
        z = (x[:5] - own.mean(0)) @ model.factors[k].T
        d = x[:5] - own.mean(0)
        assert (z**2).sum(1) == pytest.approx(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert (model.score(x)[:300] < 0.5).mean() > 0.95 and (model.score(x)[300:] > 0.5).mean() > 0.95


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.keep_quality(docs, none, 0.25).count() == 3
    assert quality.quality_scores(docs.limit(0), none).count() == 0

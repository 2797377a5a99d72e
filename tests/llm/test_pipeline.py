"""The corpus pipeline against its stages done by brute force."""

import pytest
from pyspark.sql import functions as F

from voxloom.llm.common import written

pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    from test_neardup import brute as near_brute
    from test_suffixdedup import brute as repeat_brute

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        rows = {r["doc_id"]: r for r in before.collect()}
        if name == "packing":
            found = docs.collect()
            assert {r["doc_id"] for r in found} == set(rows)
            break
        assert docs.columns == COLUMNS
        kept = {r["doc_id"]: r for r in docs.collect()}
        assert set(kept) <= set(rows)
        if name == "quality":
            good = labels.join(before, "doc_id").filter("quality = 1").count()
            assert docs.join(labels, "doc_id").filter("quality = 1").count() >= 0.95 * good
            assert docs.join(labels, "doc_id").filter("quality = 0").count() <= 0.2 * labels.filter("quality = 0").count()
        elif name == "near_duplicates":
            classes = near_brute([(i, r["text"]) for i, r in rows.items()])
            assert set(kept) == {i for i, c in classes.items() if i == c}
        elif name == "repeats":
            removed = {r[0]: r for r in repeat_brute([(i, r["text"]) for i, r in rows.items()])}
            for i, row in kept.items():
                n_bytes, n_removed = removed[str(i)][1:3]
                assert 0 <= n_bytes - n_removed - len(row["text"].encode()) <= 6 * removed[str(i)][3]
                assert row["n_chars"] == len(row["text"])
        else:
            assert set(kept) == set(rows)
    assert docs.agg(F.countDistinct("sequence_id")).first()[0] > 0


def test_run(spark, sf_dir):
    found = pipeline.run(spark, sf_dir)
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).filter("n <> m or n > 4096").isEmpty()


def test_contract():
    import __spark_entry__ as driver

    names = set(driver.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert 4 <= len(pipeline.STAGES) <= 5

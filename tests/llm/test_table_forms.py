"""Awkward tables for the search and for the stages' table forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import kdsearch, neardup, quality, suffixdedup

LONG = "lorem ipsum dolor sit amet " * 8000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "the same passage that stands in two documents " * 6, "en", "s", 276), (2, "before it: " + "the same passage that stands in two documents " * 6, "en", "s", 287),
    (3, None, None, None, None), (4, "", "en", "s", 0), (None, "x y", "en", "t", 3), (5, LONG, "en", "t", len(LONG)), (6, LONG, "de", "t", len(LONG)),
]
CLASH = ("__id", "__kept", "__gone", "id", "kept", "gone", "row", "score", "label", "x", "block", "class_id")


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS)


def labels(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(7)], "doc_id long, quality int")


FORMS = {
    "keep_quality": lambda d, spark: quality.keep_quality(d, labels(spark), 0.25),
    "one_of_each": lambda d, spark: neardup.one_of_each(d, neardup.near_duplicate_classes(d)),
    "without_repeats": lambda d, spark: suffixdedup.without_repeats(d),
}


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


@pytest.mark.parametrize("name", FORMS)
def test_clashing_columns_and_nulls(spark, name):
    plain = documents(spark)
    clash = plain.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    found = FORMS[name](clash, spark)
    assert found.columns == clash.columns
    assert rows_of(found.drop(*CLASH)) == rows_of(FORMS[name](plain, spark))
    assert rows_of(FORMS[name](plain, spark).filter("doc_id is null")) == rows_of(plain.filter("doc_id is null"))


@pytest.mark.parametrize("name", FORMS)
def test_empty_table(spark, name):
    found = FORMS[name](documents(spark, []), spark)
    assert found.collect() == [] and found.columns == documents(spark).columns


@pytest.mark.parametrize("name, times", [("keep_quality", 2), ("without_repeats", 2), ("one_of_each", 1)])
def test_repeated_rows(spark, name, times):
    plain = documents(spark).filter("doc_id is not null and doc_id < 5")
    once, twice = rows_of(FORMS[name](plain, spark)), rows_of(FORMS[name](plain.unionByName(plain), spark))
    assert twice == sorted(once * times)


def test_repeats_of_an_id_with_several_texts(spark):
    wrong = documents(spark, [(1, "a" * 300, "", "", 300), (1, "b" * 300, "", "", 300)])
    with pytest.raises(Exception, match="several texts"):
        suffixdedup.without_repeats(wrong).collect()


def test_search_with_clashing_columns_and_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 60, rng.integers(-9, 9, 5).astype(float).tolist() if k % 11 else None) for k in range(120)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = plain.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("dim", "vector", "shard", "block", "ids", "score", "rank", "row", "query_id"))])
    found = rows_of(kdsearch.top_k(clash, every=10))
    assert found == rows_of(kdsearch.top_k(plain, every=10)) and len(found) == 6 * 5


@pytest.mark.parametrize("n, wanted, parts", [(0, 8, 1), (10, 8, 1), (5000, 8, 2), (50_000, 8, 8), (50_000, 100, 13), (1 << 20, 8, 16)])
def test_parts(n, wanted, parts):
    assert kdsearch.parts_of(n, 65_536, 4096, wanted) == parts


def test_blocks_of_queries_in_slices(spark, monkeypatch):
    monkeypatch.setattr(kdsearch, "LEAST_QUERIES", 3)
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(200)], "vec_id long, embedding array<double>")
    few = rows_of(kdsearch.top_k(frame, every=5, shard_rows=50))
    monkeypatch.undo()
    assert few == rows_of(kdsearch.top_k(frame, every=5)) and len(few) == 200

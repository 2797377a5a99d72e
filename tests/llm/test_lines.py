"""Line dedup against SQL and by hand."""

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from voxloom.llm import catalogue, lines

NAV = "Home | About"


def site(spark, extra=()):
    rows = [(k, "a", f"{NAV}\nown {k}\n\n{NAV} ") for k in range(8)] + [(20 + k, "b", f"{NAV}\nrare {k}" if k == 0 else f"plain {k}") for k in range(8)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, host string, text string")


def kept(frame, **options):
    found = lines.drop_boilerplate(frame, F.col("host"), **options)
    return {r["row"]["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in found.collect()}


def test_only_the_site_that_repeats_it(spark):
    found = kept(site(spark))
    assert found[3] == (4, 2, "own 3\n") and found[20] == (2, 0, f"{NAV}\nrare 0")


def test_edges(spark):
    found = kept(site(spark, [(50, "a", None), (51, "a", ""), (52, None, NAV), (53, "a", NAV)]))
    assert found[50] == (0, 0, None) and found[51] == (1, 0, "") and found[52] == (1, 0, NAV) and found[53] == (1, 1, "")
    assert kept(site(spark).limit(0)) == {}
    with pytest.raises(ValueError):
        lines.drop_boilerplate(site(spark), F.col("host"), max_ratio=2)


def test_salted_lists_give_the_same(spark, monkeypatch):
    plain = kept(site(spark))
    monkeypatch.setattr(lines, "BROADCAST_LINES", -1)
    assert kept(site(spark)) == plain


def test_clashing_columns(spark):
    frame = site(spark).selectExpr("doc_id", "host", "text", "1 as lines", "2 as kept", "3 as site", "4 as row", "5 as salt", "6 as id")
    assert kept(frame) == kept(site(spark))


def test_native(spark, sf_dir):
    plan = catalogue.op9_lines(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query(spark, sf_dir, duck):
    assert same_rows(catalogue.op9_lines(spark, sf_dir), catalogue.oracle_sql()["op9_lines"], duck)


def test_host_of(spark):
    urls = spark.createDataFrame([("http://A.example.com/x?y",), ("nothing",), ("https://b.c#d",)], "u string")
    assert [r[0] for r in urls.select(lines.host_of(F.col("u"))).collect()] == ["a.example.com", "", "b.c"]

"""Every core query against its SQL, and the driver's contract."""

import pytest
from conftest import same_rows

from voxloom.plans import catalogue

NAMES = sorted(catalogue.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, duck, name):
    frame = catalogue.queries()[name](spark, sf_dir)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        same_rows(frame, sql, duck)
    else:
        assert frame.collect()


def test_entry(spark, sf_dir):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(NAMES) <= set(driver.queries())


def test_core_does_not_import_training_operators():
    import pathlib

    root = pathlib.Path(catalogue.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "voxloom.llm" not in path.read_text(), path


def test_pushdown(spark, sf_dir):
    """Only the columns that a query needs are read."""
    plan = catalogue.voxel_count(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert "l_shipdate" not in schema and "l_quantity" in schema


def test_band_join_is_an_equi_join(spark, sf_dir):
    plan = catalogue.assoc_candidates(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

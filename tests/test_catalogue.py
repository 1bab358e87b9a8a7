import pytest

from meridia import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_sql(agree, name):
    agree(catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_every_query_has_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLES.keys()


def test_spatial_joins_are_equi_joins(spark):
    plan = catalogue.tree_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

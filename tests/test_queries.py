"""Every query of the base library against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from terravox import queries

from .helpers import DATA, same_as_sql

SF = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    same_as_sql(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["vx", "vy", "vz", "count", "cx", "cy", "cz"] and df.count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


def test_no_range_join_is_a_nested_loop(spark):
    for name in ("segmented_sum", "segmented_argmax", "nearest_neighbor", "neighbor_join", "align_nearest"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name

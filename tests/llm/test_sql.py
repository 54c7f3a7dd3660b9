"""Queries of this subpackage against their SQL."""

import harness
import pytest
from pulseloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return harness.connect(SF)


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_matches_sql(spark, con, key):
    df = queries.QUERIES[key](spark, SF)
    assert harness.compare(df, con, queries.ORACLE[key]) is None
    assert df.count() > 0


def test_every_operator():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("key", ["op1_licenses", "op5_sharding", "op9_chat", "op10_quality"])
def test_native_plans_run_no_python(spark, key):
    plan = queries.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"))

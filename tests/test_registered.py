"""Every registered query against its SQL, on the small tables."""

import __spark_entry__ as spark_entry
import harness
import pytest

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
RARE = {"chip_charge_pairs", "downstream_filter", "hit_map"}  # have rows on the larger tables only, so they are compared there
QUERIES, ORACLE = spark_entry.queries(), spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return {d: harness.connect(d) for d in (SF, LARGER)}


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if k != "pipeline" and not k.startswith("op")))
def test_matches_sql(spark, con, key):
    d = LARGER if key in RARE else SF
    df = QUERIES[key](spark, d)
    assert not df.isEmpty()
    if key in ORACLE:
        assert harness.compare(df, con[d], ORACLE[key]) is None


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_no_sql_without_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", ["event_summary", "track_fit", "event_gap", "channel_dt", "hist1d", "gauss_fit", "contiguous_runs", "nearest_within_tol"])
def test_plan_forms_no_pairs(spark, key):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ArrowEvalPython" not in plan and "FlatMapGroups" not in plan

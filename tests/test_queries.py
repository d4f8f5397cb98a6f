"""Every registered query against its SQL twin, and the shape of the plans."""

import re

import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# The only operators whose text work needs Python in the tasks.
PYTHON = ("x1_", "x3_", "x4_", "x5_", "s10_", "s11_", "s12_", "p16_detail")


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, note, _ = compare(spark, con, SF, name, QUERIES, ORACLES)
    assert ok or (ok is None and name not in ORACLES), note


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("z", "g0", "g3", "g8", "g9", "g10", "r5", "r6", "s2", "s7", "s8", "s14"))])
def test_plan_shape(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if not name.startswith(PYTHON):
        assert not re.search(r"EvalPython|MapInPandas|BatchEval", plan)


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "points" in df.columns
    assert set(ORACLES) <= set(QUERIES)

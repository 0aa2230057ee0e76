"""Every registered query against its SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from geoseries import suite
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = suite.load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())
    modelled = set(QUERIES) - set(ORACLE)
    assert all(re.match(r"m\d\d_|x\d\d_.*_forest$", name) for name in modelled)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert word not in plan
    assert compare(df.toPandas(), duck.execute(ORACLE[name]).df()) is None


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"station_idx", "rmse", "ubrmse", "count", "r2"}

"""Registered corpus queries against their SQL, and what the entry module offers."""

import pytest

import __spark_entry__ as entry
from geoseries.llm import suite
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in suite.QUERIES}
    assert {*suite.QUERIES, "pipeline"} <= names and set(suite.ORACLE) <= set(suite.QUERIES)


@pytest.mark.parametrize("name", sorted(suite.ORACLE))
def test_query_equals_sql(spark, name):
    want = connect(SF).execute(suite.ORACLE[name]).df()
    assert compare(suite.QUERIES[name](spark, SF).toPandas(), want) is None

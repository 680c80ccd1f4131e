"""Every registered query equals its SQL."""

import pytest

import __spark_entry__ as registered
from tests.oracle import database, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", list(registered.core_queries()))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = registered.queries()[name](spark, sf_dir)
    assert differences(df, con, registered.oracle_sql()[name]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_every_query_has_sql():
    assert set(registered.core_queries()) <= set(registered.oracle_sql())


def test_entry(spark):
    df = registered.entry(spark)
    marks = {(r["pilot"], r["duplicate"]): r["count"] for r in df.groupBy("pilot", "duplicate").count().collect()}
    assert sum(n for (pilot, _), n in marks.items() if pilot == "x") == 25
    assert df.columns[:3] == ["article_id", "run_id", "source"]

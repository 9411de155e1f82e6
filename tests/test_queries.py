"""Every registered query of the library against its SQL, and its plan."""

import pytest

from tests.compare import DATA, both
from vetspark.plans import queries as q


def test_every_query_has_sql():
    assert q.QUERIES.keys() == q.SQL.keys()


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_same_as_sql(spark, name):
    mine, theirs = both(spark, q.QUERIES[name], q.SQL[name])
    assert mine == theirs


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_plan(spark, name):
    plan = q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"))


def test_flagship(spark):
    assert sum(r.n for r in q.flagship(spark, DATA).collect()) == spark.read.parquet(f"{DATA}/pages.parquet").count()


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert q.QUERIES.keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0

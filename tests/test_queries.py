"""Every registered query against its SQL on the smallest tables, and a look at the plans of all it ran."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import canonical
from lociframe.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plans(spark, since):
    """Number and plan of every execution after number ``since``, the ones behind checkpoints and written tables among them."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [(e.executionId(), e.physicalPlanDescription()) for e in (runs.apply(i) for i in range(runs.size())) if e.executionId() > since]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    since = max([i for i, _ in plans(spark, -1)], default=-1)
    df = QUERIES[name](spark, SF)
    got = df.toPandas()
    ran = [p for _, p in plans(spark, since)]
    assert ran
    for plan in ran:
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
        assert "BatchEvalPython" not in plan, "row-at-a-time Python"
    if name in SQL:
        a, b = canonical(got), canonical(con.execute(SQL[name]).fetchdf())
        assert list(a.columns) == list(b.columns)
        assert a.equals(b)
    else:
        assert len(got) > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "winner" in df.columns

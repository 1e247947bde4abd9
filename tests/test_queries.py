"""Every registered query against its oracle at sf0.001, with broadcast joins switched off.

So each join is also proven in its shuffled form; tests/check_all.py compares the broadcast
form. No plan may need a nested loop or row-at-a-time Python.
"""

import pytest

import __spark_entry__ as entry_point
from poolsight.plans.registry import REGISTRY
from tests.oracle import compare, connect

ROOT = "/root/testdata/sf0.001"
QUERIES, ORACLES = REGISTRY.queries, REGISTRY.oracles
FORBIDDEN = ("NestedLoop", "CartesianProduct", "BroadcastHashJoin", "PythonUDF", "ArrowEvalPython")


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


@pytest.fixture(autouse=True)
def shuffled_joins(spark):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    yield
    spark.conf.set(setting, before)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, ROOT)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    if name in ORACLES:
        assert compare(duck, df, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["principal", "dbus", "est_list_cost_usd", "jobs", "last_active"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

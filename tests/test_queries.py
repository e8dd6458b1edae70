"""Every query that has SQL must agree with it; the others must run."""

from __future__ import annotations

import os

import pytest

from corvane.plans import catalog
from tests.compare import assert_same, connect
from tests.conftest import DATA, TABLES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA, TABLES)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    assert_same(catalog.queries()[name](spark, DATA), duck.sql(catalog.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).columns


def test_entry_is_registered():
    assert catalog.FLAGSHIP in catalog.queries()


def test_filters_reach_the_scan(spark):
    plan = catalog.queries()["anti_scope"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,300000.0)" in plan and "ReadSchema: struct<o_custkey" in plan

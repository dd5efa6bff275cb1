"""Every named query against its SQL, and plan checks that hold for all of them."""

from __future__ import annotations

import __spark_entry__ as entry_module
import compare
import pytest
from conftest import SMALL

from riskloom.registry.oracle import ORACLE
from riskloom.registry.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


def test_every_query_is_registered():
    assert QUERIES.items() <= entry_module.queries().items()
    assert ORACLE.items() <= entry_module.oracle_sql().items()


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare.difference(df, con, ORACLE[name]) is None


def test_entry_returns_the_exposure_mart(spark):
    df = entry_module.entry(spark)
    assert df.count() == 150
    assert "portfolio_status" in df.columns


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["mart_account_health"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_custkey)" in plan
    assert "o_totalprice" not in plan and "o_orderpriority" not in plan


@pytest.mark.parametrize("name", ["retrieve_keyword_topk", "silver_dedup_latest", "retrieve_vector_topk"])
def test_ranking_is_cut_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2

"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import re

import compare
import pytest

import __spark_entry__ as entry_points
from rowkeel.plans.oracle import oracle
from rowkeel.plans.queries import registered

QUERIES = registered()
ORACLE = oracle()
IN_PYTHON = {"knn_exact", "knn_cells", "knn_dirty", "knn_lsh", "knn_graph"}


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    assert compare.differences(df, con, ORACLE[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in IN_PYTHON:
        assert "InArrow" not in plan and "ArrowEval" not in plan


def test_entry_points_hold_every_query():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLE) <= set(entry_points.oracle_sql())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["child", "child_columns", "parent", "orphan_rows"]
    assert [r["parent"] for r in df.collect()] == ["orders"]


def test_audit_scans_each_table_once_and_only_its_keys(spark, sf):
    plan = QUERIES["fk_audit_all"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?/(\w+)\.parquet", plan)
    tables = [t for _, t in scans]
    assert len(tables) == len(set(tables)) == 10
    lineitem = next(cols for cols, t in scans if t == "lineitem")
    assert re.sub(r"#\d+L?", "", lineitem) == "l_orderkey,l_partkey,l_suppkey"
    # values by parent, then the totals
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Join" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["partial_unique_violations"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan
    assert "l_extendedprice" not in plan

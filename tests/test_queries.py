"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from workload import tree_queries

# the training-data queries come and go with their subpackage, which has tests of its own
QUERIES = {n: q for n, q in entry.queries().items() if not n.startswith("op") and n != "pipeline"}
ORACLE = {n: q for n, q in entry.oracle_sql().items() if n in QUERIES}
WRITING = {"i32_sync_state", "i37_compacted_tool_calls", "i38_synced_sessions", "s01_daily_messages", "s02_weekly_write_read", *tree_queries.QUERIES}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_names_agree():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf, con, name):
    result = QUERIES[name](spark, sf)
    if name in ORACLE:
        got, want = compare(result, ORACLE[name], con)
        assert got == want
    else:
        assert result.count() > 0
    # read off the executed plan: no pairs of everything, no Python, no unbounded window in one task
    plan = result._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert node not in plan, node


def test_single_task_windows_see_grouped_rows_only(spark, sf):
    """A window over all rows is allowed on days or weeks, after grouping."""
    alone = []
    for name in sorted(set(QUERIES) - WRITING):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        for spec in re.findall(r"windowspecdefinition\(([^\n]*?), specifiedwindowframe", plan):
            first = spec.split(",")[0]
            if " ASC" in first or " DESC" in first:
                alone.append(name)
    assert set(alone) <= {"r19_longest_streak", "d03_spend_trend"}


def test_flagship(spark):
    result = entry.entry(spark)
    assert result.count() > 0 and "est_cost_usd" in result.columns

"""Every registered query against its SQL, over whole tables."""

import pytest
from compare import compare, connect
from conftest import SF

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry_is_lazy_frame_with_stable_schema(spark):
    assert entry.entry(spark).columns == ["q_id", "information"]


def test_plans_stay_free_of_cross_joins(spark):
    for name in ("search_top_k", "keyword_windows", "join_pages", "token_chunks", "resume_unprocessed"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name

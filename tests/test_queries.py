"""Every registered query of the engine's own operators against its SQL on the smallest tables."""

import pytest

from tests.conftest import rows
from thoughtloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = rows(QUERIES[name](spark, sf).toPandas())
    want = rows(duck.execute(SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_search_plans_without_nested_loops(spark, sf):
    for name in ("s06_fulltext_search", "s07_suggest", "s08_hybrid_search", "s10_rerank_fusion", "s11_context_pack"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_no_cross_join_nor_python_in_relational_plans(spark, sf):
    names = ["j07_shared_entity_pairs", "j08_influenced_by", "j14_unresolved_contradictions", "a01_timeline_month", "e04_batch_resolution", "e06_fuzzy_match"]
    for name in [*names, "r02_dormant_alternatives", "r07_assumption_violations", "r08_alert_overlap", "r10_token_budget", "x15_injection_scan"]:
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan and "Pandas" not in plan, name


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 15
    assert set(e.oracle_sql()) <= set(e.queries())

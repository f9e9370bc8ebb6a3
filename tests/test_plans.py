"""Plans read no more than they need, and join by keys."""

import pytest

from retail_lens import catalog, registry
from retail_lens.plans.facts import facts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "columns"), [
    ("store_contacts", {"c_custkey", "user_id", "event_id", "event_type"}), ("majority_code", {"o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"}), ("detection_methods", {"event_id", "user_id", "event_type"}),
    ("refusal_window", {"user_id", "ts", "event_type"}), ("brand_relations", {"l_suppkey", "l_partkey", "p_partkey", "p_brand", "s_suppkey"}),
])
def test_scans_are_pruned(spark, name, columns):
    got = facts(registry.queries()[name](spark, SF))
    assert got.columns <= columns | {"s_name", "l_discount", "l_shipdate"} and got.products == 0 and got.python == 0


def test_filters_reach_the_scan(spark):
    assert any("EqualTo(event_type,error)" in f for f in facts(registry.queries()["refusal_window"](spark, SF)).pushed)
    assert any("o_orderstatus" in f for f in facts(registry.queries()["majority_code"](spark, SF)).pushed)


def test_radius_and_claims_join_by_keys(spark):
    for name in ("nearest_within_radius", "evidence_containment", "match_cascade", "discovery_matches"):
        assert facts(registry.queries()[name](spark, SF)).products == 0, name


@pytest.mark.parametrize("name", ["topk_values", "bounded_distinct_list", "brand_domains"])
def test_firsts_are_cut_in_each_task_before_they_meet(spark, name):
    """No row_number ranks all rows of a hot key: each task keeps the first k of a key, and only these are shuffled and ranked."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    before, after = plan.find("WindowGroupLimit"), plan.rfind("WindowGroupLimit")
    assert 0 <= before < after and "Exchange" in plan[before:after] and "Partial" in plan[after:]


def test_no_window_holds_all_rows_of_brands_or_stores(spark):
    for name in ("brand_rank", "quartiles_exclusive", "describe"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "collect_list(price" not in plan and "percentile(" not in plan, name


def test_tasks_that_group_listings_have_bounded_rows(spark):
    """Both steps that group rows as many as lines deal them by a number of rows a task, which neither Spark's coalescing nor the size of the tables changes."""
    assert catalog.dealt(spark.range(10), 40 * catalog.TASK_ROWS + 1, "id").rdd.getNumPartitions() == 41
    assert registry.queries()["composite_dedupe"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2

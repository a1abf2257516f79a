"""Plans that queries should have."""

import re

from jobloom.operators import dispatch, limits, retention, search
from jobloom.plans import queries as q
from jobloom.sources import fixtures as fx
from jobloom.sources.fixtures import NOW_MS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feed_is_a_top_k_with_pruned_columns(spark, sf):
    p = plan(search.failures(fx.job_history(spark, sf), name="q2"))
    assert "TakeOrderedAndProject" in p and "Window" not in p
    assert "PushedFilters: [" in p
    orders = next(s for s in re.findall(r"ReadSchema: struct<([^>]*)>", p) if "o_orderkey" in s)
    assert "o_orderpriority" not in orders


def test_newest_rows_are_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(retention.by_count(fx.job_history(spark, sf), "Failed", 50))


def test_blocked_facets_are_an_anti_join_with_a_broadcast(spark, sf):
    rules, counters, _ = fx.rate_rules(spark)
    p = plan(dispatch.runnable(fx.jobs(spark, sf), NOW_MS, rules, counters))
    assert re.search("BroadcastHashJoin.*LeftAnti", p) and "CartesianProduct" not in p


def test_no_query_joins_without_a_key(spark, sf):
    for name in ("state_counts", "backlog_pressure", "prune_receipts_orphans", "ancestry_check", "duration_histogram", "failure_ratio", "load_percentiles"):
        p = plan(q.QUERIES[name](spark, sf))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_aggregates_combine_before_they_shuffle(spark, sf):
    p = plan(q.backlog_pressure(spark, sf))
    assert p.count("HashAggregate") >= 2 and "partial_count" in p


def test_blocked_facets_read_rules_only(spark):
    rules, counters, _ = fx.rate_rules(spark)
    assert limits.blocked_facets(rules, counters, NOW_MS).columns == ["rate_limit_facet"]


def test_trees_join_once_a_round(spark, sf):
    """Pointers double, and each round reads what the one before has written."""
    assert plan(q.lineage_depth(spark, sf)).count("Join") <= 3
    assert plan(q.fail_parent_cascade(spark, sf)).count("Join") == 0


def test_orders_of_dispatch_are_ranked_in_parallel(spark, sf):
    for name in ("dispatch_fifo", "dispatch_fair"):
        lines = plan(q.QUERIES[name](spark, sf)).splitlines()
        for i, line in enumerate(lines):
            if "SinglePartition" in line:  # only aggregated counts and heads come together
                assert any("HashAggregate" in x or "SortAggregate" in x or "Project" in x or "Window" in x for x in lines[i + 1 : i + 3]), name
        assert "CartesianProduct" not in "".join(lines)


def test_nodes_out_of_reach_have_no_depth(spark):
    from jobloom.operators import flows

    chain = [("a", None)] + [(f"c{i}", f"c{i - 1}" if i else "a") for i in range(6)]
    rows = spark.createDataFrame([*chain, ("lost", "nowhere"), ("x", "y"), ("y", "x")], "id string, parent_id string")
    got = {r.id: (r.depth, r.root) for r in flows.depths(rows, max_height=4).collect()}
    assert got == {"a": (0, "a"), **{f"c{i}": (i + 1, "a") if i < 4 else (None, None) for i in range(6)}, "lost": (None, None), "x": (None, None), "y": (None, None)}

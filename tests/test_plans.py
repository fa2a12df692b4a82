"""Physical-plan guards: pushdown reaches the scan, narrow read schemas, and no
cartesian or nested-loop joins in the main queries."""

import pytest

SF_SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushdown_and_pruning(spark):
    import __spark_entry__ as E
    p = _plan(E.queries()["a1_posts_scan"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz," \
           "o_orderpriority:string>" in p


@pytest.mark.parametrize("name", ["j2_user_pairs_clean", "d17_daily_engagement", "d10_comment_percentiles",
                                  "e13_auc_labels", "a12_listing_merge", "e26_sessions", "e24_max_actions_60s"])
def test_no_cartesian_or_nested_loop_joins(spark, name):
    import __spark_entry__ as E
    p = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_top_k_is_limited_before_the_shuffle(spark):
    import __spark_entry__ as E
    p = _plan(E.queries()["a7_new_listing"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p

"""Plan checks: pushdown, no Python in relational stages, bounded windows, top-k operators."""

from churnlake.operators import features as FE
from churnlake.operators import quality as Q
from churnlake.operators import rules as R
from churnlake.operators.slicing import explore_topk, slice_filter
from churnlake.plans import stages
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    """The formatted physical plan (what ``explain("formatted")`` prints)."""
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_feature_stage_is_one_projection_without_joins_or_python(spark):
    plan = _plan(FE.engineer_features(stages.base(spark, SF_SMALL)))
    assert "Join" not in plan and "Python" not in plan and "ArrowEval" not in plan


def test_rules_use_a_broadcast_join_and_no_python(spark):
    plan = _plan(R.assign_actions(stages.features(spark, SF_SMALL)))
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def test_slice_filter_is_pushed_into_the_stage_scan(spark):
    df = slice_filter(stages.features(spark, SF_SMALL), geography="Germany", age=(30, 60))
    plan = _plan(df)
    pushed = plan[plan.index("PushedFilters"):]
    assert "EqualTo(Geography,Germany)" in pushed and "GreaterThanOrEqual(Age,30)" in pushed


def test_stage_scan_reads_only_needed_columns(spark):
    df = stages.features(spark, SF_SMALL).select("CustomerId", "Balance")
    plan = _plan(df)
    assert "ReadSchema: struct<CustomerId:bigint,Balance:double>" in plan


def test_topk_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in _plan(explore_topk(stages.base(spark, SF_SMALL)))


def test_sample_value_lists_use_a_group_limit(spark):
    q = Q.quality_summary(stages.base(spark, SF_SMALL))
    q.collect()
    assert "WindowGroupLimit" in q._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in q._jdf.queryExecution().optimizedPlan().toString()


def test_customer_base_broadcasts_only_the_nation_dimension(spark):
    from churnlake.sources.base import customer_base
    plan = _plan(customer_base(spark, SF_SMALL))
    assert "BroadcastExchange" in plan
    assert plan.count("BroadcastExchange") == 1 or "AdaptiveSparkPlan" in plan


def test_no_window_without_partition(spark):
    import re
    from churnlake.operators import explain as X
    from churnlake.plans.q_xai import linear_long
    qs = [Q.quality_summary(stages.base(spark, SF_SMALL)), X.row_drivers(linear_long(spark, SF_SMALL))]
    for q in qs:
        plan = q._jdf.queryExecution().optimizedPlan().toString()
        windows = [ln for ln in plan.splitlines() if "Window [" in ln]
        assert windows
        for ln in windows:
            m = re.search(r"AS [^\]]*\], \[([^\]]*)\], \[", ln)
            assert m and m.group(1).strip(), ln     # the partition spec is not empty


def test_linear_row_drivers_shuffle_nothing(spark):
    from churnlake.operators import explain as X
    from churnlake.plans.q_xai import COEFS, _geo, linear_long
    base = stages.base(spark, SF_SMALL)
    df = X.linear_row_drivers(_geo(base), COEFS)
    assert "Exchange" not in _plan(df)
    want = X.row_drivers(linear_long(spark, SF_SMALL))
    assert sorted(df.collect()) == sorted(want.collect())


def test_totals_come_from_grouped_counts(spark):
    from churnlake.operators import eda
    q = eda.churn_distribution(stages.base(spark, SF_SMALL))
    q.collect()
    assert "ReusedExchange" in q._jdf.queryExecution().executedPlan().toString()
    assert _plan(eda.churn_by_geography(stages.base(spark, SF_SMALL))).count("- Scan parquet") == 1

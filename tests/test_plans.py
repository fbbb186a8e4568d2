"""Physical-plan properties that matter at scale."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def qs():
    return E.queries()


def test_rank_is_limited_before_the_shuffle(spark, qs):
    p = plan_of(qs["wide_features"](spark, SF))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_leaderboard_per_feature_is_limited(spark, qs):
    p = plan_of(qs["leaderboard_by_feature"](spark, SF))
    assert "WindowGroupLimit" in p


def test_filters_and_columns_reach_the_scan(spark, qs):
    df = qs["scan_parquet"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double," \
           "l_returnflag:string>" in p


def test_event_filter_pushed(spark):
    from huddle.layout import DRIVER
    from huddle.operators.frames import event_frame_filter
    from huddle.sources.standin import driver_frames
    p = plan_of(event_frame_filter(driver_frames(spark, SF), DRIVER, None))
    assert "IsNotNull(o_orderpriority)" in p


def test_no_cartesian_products(spark, qs):
    for name, fn in qs.items():
        if name.startswith(("segment_model", "segment_confusion", "segment_importances", "tuned_forest", "grid_search", "random_search", "top_importances", "entity_model",
                            "assemble_features", "label_encode")):
            continue
        p = plan_of(fn(spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_frame_before_event_never_windows_the_whole_key(spark, qs):
    p = plan_of(qs["frame_before_event"](spark, SF))
    assert "Window" not in p


def test_dims_broadcast_only_under_limit(spark):
    from huddle.session import bounded_broadcast, estimated_size
    from huddle.sources.readers import read_table
    part = read_table(spark, SF, "part")
    assert estimated_size(part) > 0
    hinted = bounded_broadcast(part, limit=1)  # nothing fits one byte
    assert "broadcast" not in hinted._jdf.queryExecution().logical().toString().lower()


def test_only_used_dimensions_are_joined(spark, qs):
    for name in ("event_frame_filter", "wide_features", "avg_by_team", "accuracy_by_segment", "ols_by_group"):
        p = plan_of(qs[name](spark, SF))
        assert "part.parquet" not in p, name
    assert "customer.parquet" not in plan_of(qs["event_frame_filter"](spark, SF))
    assert "part.parquet" in plan_of(qs["merge_frames"](spark, SF))


def test_wide_features_hash_aggregates_without_row_ids(spark, qs):
    p = plan_of(qs["wide_features"](spark, SF))
    assert "monotonically_increasing_id" not in p and "SortAggregate" not in p and "WindowGroupLimit" in p

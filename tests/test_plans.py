"""Physical plans: no nested loops, no single task for a keyed series, filters at the scan."""

import pytest

from queries import load

SF = "/root/testdata/sf0.001"
KEYED = [
    "rolling_mean", "rolling_std_pop", "rolling_slope", "lag_diff", "ffill_bfill", "gap_hours", "run_segments", "flag_intervals", "local_peaks",
    "interp_limit_both", "impute_gap_rule", "asof_last_event", "exact_then_ffill", "interval_labels", "hazard_labels", "resample_ffill",
    "dst_features_split", "upsert_replace", "upsert_ignore", "dedupe_last", "group_last", "missing_ranges", "greedy_spacing", "prominent_peaks",
]


def plan(spark, name):
    return load()[0][name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", KEYED)
def test_keyed_queries_stay_distributed(spark, name):
    text = plan(spark, name)
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert "SinglePartition" not in text


@pytest.mark.parametrize("name", ["rolling_mean", "lag_diff", "ffill_bfill", "run_segments", "interp_limit_both"])
def test_series_are_cut_into_chunks(spark, name):
    text = plan(spark, name)
    windows = [line for line in text.split("\n") if " Window [" in line and "_chunk" in line]
    assert windows and "hashpartitioning(k#" in text and "_chunk#" in text


@pytest.mark.parametrize("name", sorted(load()[0]))
def test_no_nested_loops_anywhere(spark, name):
    if name in ("train_horizon", "prune_features", "score_splits", "forecast_horizons", "design_matrix") or name.startswith("stream"):
        pytest.skip("runs jobs while it is built")
    text = plan(spark, name)
    assert "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name, filters", [
    ("filter_date_range", "GreaterThanOrEqual(o_orderdate,1996-03-01"), ("retention", "GreaterThanOrEqual(l_shipdate"),
    ("route_segments", "GreaterThanOrEqual(ts,2024-01-05"),
])
def test_time_filters_reach_the_scan(spark, name, filters):
    assert filters in plan(spark, name)


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "rolling_mean")
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text


LANDED = {"landed_dst", "landed_cme", "landed_kp_index", "landed_radio_flux", "landed_flares"}  # their files are written first
WRITES = LANDED | {"merge_bucketed"} | {  # sinks, streams, model fits and statistics that reach the driver run jobs while they are built
    "train_horizon", "prune_features", "score_splits", "forecast_horizons", "design_matrix", "sink_roundtrip", "report_files", "isotonic_calibrate",
    "corr_pairs", "top_pairs", "vif", "vif_dependent", "condition_number", "near_degenerate", "require_complete",
}


@pytest.mark.parametrize("name", sorted(n for n in load()[0] if n not in WRITES and not n.startswith("stream")))
def test_building_a_query_runs_no_job(spark, name):
    load()[0][name](spark, SF)  # schemas of the tables are read once
    context = spark.sparkContext
    context.setJobGroup(f"build {name}", name)
    try:
        load()[0][name](spark, SF)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert not context.statusTracker().getJobIdsForGroup(f"build {name}")


def test_bucketed_merge_moves_nothing(spark):
    text = plan(spark, "merge_bucketed")
    assert text.count("SortMergeJoin") == 5 and "Bucketed: true" in text
    assert "Exchange" not in text and "Sort [" not in text and "Broadcast" not in text

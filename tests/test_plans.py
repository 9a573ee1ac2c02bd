"""Plans that hold at scale: no pairs within groups, filters and columns reach the scan."""

from __future__ import annotations

import pytest

from catalog import alerting, features, packets, vectors, windows
from tidegauge.operators import extras

SF = "/root/testdata/sf0.001"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "build",
    [
        features.feature_rows, windows.burst_features, windows.topology_features,
        windows.value_statistics, windows.pivot_window_sizes, alerting.handled,
        alerting.escalate_priority, alerting.incident_rollup, alerting.prior_alert_context,
        packets.packets_to_features, vectors.ks_drift,
    ],
)
def test_no_pairs_and_no_python(spark, build):
    plan = plan_of(build(spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan


def test_volume_reads_only_its_columns(spark, folder):
    from catalog import views
    from tidegauge.operators.windows import assign_windows
    from tidegauge.operators.features import volume_features

    views.messages(spark, SF).write.parquet(folder + "/m")
    plan = plan_of(volume_features(assign_windows(spark.read.parquet(folder + "/m"), (60,))))
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert sorted(f.split(":")[0] for f in schema.split(",")) == [
        "dst_ip", "payload_size", "protocol", "src_ip", "ts_us",
    ]
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan


def test_a_hot_flow_is_cut_by_time(spark):
    from catalog import views
    from tidegauge.operators.windows import inter_arrivals

    plan = plan_of(inter_arrivals(views.messages(spark, SF), (60, 300), 60))
    assert "slice" in plan.split("Exchange hashpartitioning(")[1].split(")")[0]


def test_distinct_pairs_come_before_the_baseline_join(spark):
    rows = windows.windowed(spark, SF)
    plan = plan_of(extras.topology_features(rows, rows.select("src_ip", "dst_ip")))
    assert "LeftOuter" in plan and "HashAggregate" in plan.split("LeftOuter")[1]

"""Rules relative to what is usual for a flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import classify as cl

ROW = (
    "src_ip string, dst_ip string, protocol string, window_size bigint, window_start bigint, "
    "message_count bigint, bytes_total bigint, bytes_max bigint, iat_std double, iat_max double"
)
RULES = {kind: cl.RULES[kind] for kind in ("volume_anomaly", "timing_anomaly")}


def test_rules_relative_to_the_baseline(spark):
    usual = [("a", "b", "modbus", 60, 60 * i, 10, 1000, 100, 0.1, 1.0) for i in range(4)]
    baseline = cl.flow_baseline(spark.createDataFrame(usual, ROW))
    cases = {  # count, bytes of a window, and the type
        0: (10, 1000, "unknown"), 1: (21, 1000, "volume_anomaly"), 2: (10, 3001, "volume_anomaly"),
        3: (16, 1000, "timing_anomaly"), 4: (4, 1000, "timing_anomaly"), 5: (15, 3000, "unknown"), 6: (None, None, "unknown"),
    }
    rows = [("a", "b", "modbus", 60, i, n, b, 100, 0.1, 1.0) for i, (n, b, _) in cases.items()]
    rows.append(("new", "b", "modbus", 60, 99, 500, 50000, 100, 0.1, 1.0))  # no baseline, so no relative rule
    judged = cl.with_baseline(spark.createDataFrame(rows, ROW), baseline)
    got = {r.window_start: r.kind for r in judged.select("window_start", cl.rule_type(RULES, True).alias("kind")).collect()}
    assert got == {i: kind for i, (_, _, kind) in cases.items()} | {99: "unknown"}
    plain = judged.select(cl.rule_type(RULES).alias("kind")).distinct().collect()
    assert [r.kind for r in plain] == ["unknown"]
    assert judged.filter(F.col("src_ip") == "new").count() == 1

"""Window and feature values of small message sets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.operators import envelope, features, windows
from tidegauge.operators.features import FeatureSet, register_extractor

START = "2024-01-01T12:00:0{}Z"
EPOCH = 1704110400


def messages(spark, rows, protocol):
    """Rows of dicts with the offset in seconds first, as JSON messages with a nested body."""
    data = []
    for i, row in enumerate(rows):
        row = dict(row)
        data.append({
            "protocol": protocol, "timestamp": START.format(row.pop("at")), "src_ip": "10.0.0.1",
            "dst_ip": "10.0.0.2", "src_port": 49152, "dst_port": row.pop("dst_port", 502),
            "payload_size": row.pop("size"), "message": row,
        })
    frame = spark.createDataFrame(data, schemas.MESSAGE)
    return envelope.unnest_message(frame)


def vector(spark, rows, protocol):
    (row,) = features.extract_features(messages(spark, rows, protocol), (60,)).collect()
    return row


MODBUS = [
    {"at": 0, "size": 61, "function_code": 4, "unit_id": 3, "start_address": 40, "quantity": 2},
    {"at": 2, "size": 20, "function_code": 4, "unit_id": 3, "start_address": 44, "quantity": 6},
    {"at": 3, "size": 33, "function_code": 15, "unit_id": 3, "start_address": 8, "quantity": 12},
    {"at": 7, "size": 20, "function_code": 4, "unit_id": 7, "start_address": 40, "quantity": 2},
    {"at": 8, "size": 46, "function_code": 1, "unit_id": 5, "start_address": 72, "quantity": 8, "dst_port": 49200},
]


def test_modbus(spark):
    v = vector(spark, MODBUS, "modbus")
    assert (v.message_count, v.bytes_total, v.bytes_mean, v.bytes_min, v.bytes_max) == (5, 180, 36, 20, 61)
    assert v.bytes_std == pytest.approx(249.2**0.5)
    assert (v.fc_unique_count, v.fc_most_common, v.fc_most_common_ratio) == (3, 4, 0.6)
    assert (v.fc_read_ratio, v.fc_write_ratio) == (0.8, 0.2)
    assert v.fc_entropy == pytest.approx(1.37095, abs=1e-5)  # shares of 3, 1 and 1 in 5
    assert (v.unit_id_unique_count, v.addr_unique_count) == (3, 4)
    assert (v.addr_min, v.addr_max, v.addr_range, v.addr_mean) == (8, 72, 64, 40.8)
    assert (v.qty_mean, v.qty_max) == (6, 12)
    assert (v.iat_mean, v.iat_min, v.iat_max, v.iat_median) == (2, 1, 4, 1.5)  # gaps 2, 1, 4, 1
    assert v.iat_std == pytest.approx(1.5**0.5)
    assert (v.request_count, v.response_count, v.request_ratio) == (4, 1, 0.8)
    assert v.msg_type_unique is None and v.master_ratio is None


def test_modbus_exception(spark):
    rows = [
        {"at": 5, "size": 9, "function_code": 16, "is_exception": True, "exception_code": 4},
        {"at": 6, "size": 9, "function_code": 16, "start_address": 12, "quantity": 1},
    ]
    v = vector(spark, rows, "modbus")
    assert (v.exception_count, v.exception_ratio, v.exception_codes_unique) == (1, 0.5, 1)
    assert (v.request_count, v.response_count) == (1, 1)
    assert (v.addr_unique_count, v.addr_mean, v.qty_max) == (1, 12, 1)


def test_a_single_message_has_no_gaps_and_no_addresses(spark):
    v = vector(spark, [{"at": 9, "size": 8, "function_code": 7}], "modbus")
    assert (v.iat_mean, v.iat_std, v.iat_min, v.iat_max, v.iat_median) == (0, 0, 0, 0, 0)
    assert (v.addr_unique_count, v.addr_mean, v.addr_std, v.qty_max, v.fc_entropy) == (0, 0, 0, 0, 0)


def test_dnp3(spark):
    rows = [
        {"at": 0, "size": 18, "source": 3, "destination": 20, "is_master": True,
         "application": {"function_code": 2, "objects": [{"group": 12, "variation": 1}, {"group": 41, "variation": 2}]}},
        {"at": 4, "size": 22, "source": 20, "destination": 3, "is_master": False,
         "application": {"function_code": 129, "objects": [{"group": 2, "variation": 2}]}},
        {"at": 5, "size": 18, "source": 3, "destination": 21, "is_master": True,
         "application": {"function_code": 1, "objects": [{"group": 32, "variation": 5}]}},
    ]
    v = vector(spark, rows, "dnp3")
    third = pytest.approx(1 / 3)
    assert v.fc_unique_count == 3
    assert (v.fc_read_ratio, v.fc_write_ratio, v.fc_response_ratio) == (third, third, third)
    assert (v.dnp3_src_unique, v.dnp3_dst_unique, v.dnp3_addr_pairs) == (2, 3, 3)
    assert (v.obj_group_unique, v.unsolicited_count) == (4, 0) and v.master_ratio == pytest.approx(2 / 3)
    assert (v.obj_binary_input_ratio, v.obj_binary_output_ratio) == (0.25, 0.25)
    assert (v.obj_analog_input_ratio, v.obj_analog_output_ratio) == (0.25, 0.25)


def test_dnp3_application_code_zero_falls_through(spark):
    rows = [{"at": 0, "size": 1, "function_code": 4, "application": {"function_code": 0}}]
    flat = messages(spark, rows, "dnp3").first()
    assert flat.dnp3_code == 4


def test_opcua(spark):
    kinds = ["Message", "Error", "Acknowledge", "Message"]
    services = ["Read", "CloseSecureChannel", None, "Read"]
    rows = [
        {"at": 2 * n, "size": 40 + n, "message_type": kind, "secure_channel_id": channel, "security_token_id": token,
         "service_type": service, "sequence_number": number}
        for n, (kind, channel, token, service, number) in enumerate(zip(kinds, [4, 4, 6, 4], [11, 11, 12, 0], services, [7, 9, 12, 8]))
    ]
    v = vector(spark, rows, "opcua")
    assert (v.msg_type_unique, v.msg_handshake_ratio, v.msg_data_ratio, v.msg_error_ratio) == (3, 0.25, 0.5, 0.25)
    assert (v.channel_unique, v.token_unique, v.channel_reuse_ratio) == (2, 2, 0.5)
    assert (v.service_unique, v.service_open_channel, v.service_close_channel) == (2, 0, 1)
    assert v.sequence_gaps == 2  # 10 and 11


def test_sequence_gaps_count_missing_numbers(spark):
    rows = [{"at": i, "size": 1, "message_type": "Message", "sequence_number": n}
            for i, n in enumerate([10, 3, 3, 0, 5])]
    assert vector(spark, rows, "opcua").sequence_gaps == 1 + 4


def test_unknown_protocol_is_measured_as_modbus(spark):
    v = vector(spark, MODBUS, "unknown")
    assert (v.protocol, v.feature_protocol, v.fc_unique_count) == ("unknown", "modbus", 3)


def test_most_common_tie_goes_to_the_first(spark):
    rows = [{"at": i, "size": 1, "function_code": c} for i, c in enumerate([9, 3, 3, 9])]
    assert vector(spark, rows, "modbus").fc_most_common == 9


def test_top_level_code_wins_over_the_body(spark):
    frame = spark.createDataFrame(
        [{"protocol": "modbus", "timestamp": START.format(0), "function_code": 5, "unit_id": 9,
          "start_address": 1, "message": {"function_code": 3, "unit_id": 2, "start_address": 7}}],
        schemas.MESSAGE,
    )
    row = envelope.unnest_message(frame).first()
    assert (row.function_code, row.unit_id, row.start_address) == (5, 9, 7)
    assert (row.src_ip, row.dst_ip) == ("unknown", "unknown")


def test_unreadable_time_takes_arrival_but_makes_no_gap(spark):
    frame = spark.createDataFrame(
        [{"protocol": "modbus", "src_ip": "a", "dst_ip": "b", "timestamp": t}
         for t in (START.format(0), START.format(4), "junk")], schemas.MESSAGE,
    ).withColumn("ingest_ts", F.timestamp_seconds(F.lit(EPOCH + 2)))
    (row,) = features.extract_features(envelope.unnest_message(frame), (60,)).collect()
    assert (row.message_count, row.iat_mean) == (3, 4)


def test_windows(spark):
    rows = [("a", "b", "modbus", EPOCH + s) for s in (5, 30, 65)] + [("c", "b", "modbus", EPOCH + 5)]
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, protocol string, s bigint")
    frame = frame.withColumn("ts_us", F.col("s") * 1_000_000)
    bounds = windows.window_bounds(windows.assign_windows(frame, (60, 300))).collect()
    counts = {(r.src_ip, r.window_size, r.window_start): r.message_count for r in bounds}
    assert counts == {
        ("a", 60, EPOCH): 2, ("a", 60, EPOCH + 60): 1, ("a", 300, EPOCH): 3,
        ("c", 60, EPOCH): 1, ("c", 300, EPOCH): 1,
    }


def test_slices_give_the_same_gaps(spark):
    rows = [("a", "b", "modbus", EPOCH * 1_000_000 + (i * i * 7919) % 3_600_000_000) for i in range(500)]
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, protocol string, ts_us bigint")
    def timing(slice_seconds):
        got = features.timing_features(frame, (60, 300, 900), slice_seconds).collect()
        return {tuple(r)[:5]: [round(x, 9) for x in tuple(r)[5:]] for r in got}
    assert timing(None) == timing(60) == timing(7) == timing(1)


@pytest.mark.parametrize("sizes", [(3600, 21600, 86400), (3600, 5400), (600,)])
def test_windows_merged_from_panes_are_the_same(spark, sizes):
    from catalog import views

    def plain(frame):
        rows = frame.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes]).collect()
        return sorted((tuple(0.0 if v == 0 else v for v in r) for r in rows), key=str)

    found = views.messages(spark, "/root/testdata/sf0.001")
    merged = features.extract_features(found, sizes, roll_up=True)
    assert plain(merged) == plain(features.extract_features(found, sizes))


def test_deviations_are_exact_after_merging(spark):
    rows = [("a", "b", "modbus", 60_000_000 * i, 10**12 + i % 3, i) for i in range(30)]
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, protocol string, ts_us bigint, payload_size bigint, msg_id bigint")
    from tidegauge.operators import panes

    (row,) = panes.measured(frame, {"d": panes.spread("payload_size"), "m": panes.mean("payload_size")}, (60, 1800)).filter(
        "window_size = 1800").collect()
    assert row.d == pytest.approx((2 / 3) ** 0.5, abs=1e-12) and row.m == 10**12 + 1


def test_a_hot_flow_is_sorted_in_slices_of_the_smallest_size(spark):
    rows = spark.range(20_000).select(
        F.lit("a").alias("src_ip"), F.lit("b").alias("dst_ip"), F.lit("modbus").alias("protocol"), (F.col("id") * 180_000).alias("ts_us")
    )
    plan = windows.inter_arrivals(rows, (60, 300, 900))._jdf.queryExecution().executedPlan().toString()
    assert "slice" in plan.split("Exchange hashpartitioning(")[1].split(")")[0]
    sliced = windows.slice_gaps(rows, 60).groupBy("slice").count()
    assert sliced.count() == 60 and sliced.agg(F.max("count")).first()[0] < 400
    got = features.timing_features(rows, (60, 300, 900)).filter("window_size = 900").collect()
    assert len(got) == 4 and all(r.iat_median == r.iat_min == r.iat_max == 0.18 for r in got)


def test_a_new_protocol_can_be_registered(spark):
    register_extractor("s7", lambda: FeatureSet(
        measures={"s7_big": F.count_if(F.col("payload_size") > 60)},
        outputs={"s7_big_count": F.col("s7_big")},
    ))
    try:
        v = vector(spark, MODBUS, "S7")
        assert (v.feature_protocol, v.s7_big_count, v.fc_unique_count) == ("s7", 1, None)
    finally:
        features._REGISTRY.pop("s7")


def test_vector_record_round_trip(spark):
    rows = features.extract_features(messages(spark, MODBUS, "modbus"), (60,))
    record = features.to_vector_records(rows, F.timestamp_seconds(F.lit(EPOCH)))
    assert record.columns[:3] == ["window_key", "extracted_at", "protocol"]
    back = features.from_vector_records(record)
    assert back.first().asDict() == rows.select(*back.columns).first().asDict()

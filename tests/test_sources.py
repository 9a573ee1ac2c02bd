"""Records from files, quarantine, keyed output, labelled sensor tables."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import envelope, features
from tidegauge.plans import jobs
from tidegauge.sources import topics


def write(folder, name, lines):
    path = Path(folder) / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def packet(**changes):
    base = {
        "timestamp": "2024-01-15T10:30:00Z", "src_ip": "192.168.1.1", "dst_ip": "192.168.1.2",
        "src_port": 49152, "dst_port": 502, "protocol": "tcp", "ics_protocol": "modbus",
        "payload_size": 12, "payload_hex": "00010000000601030000000a",
    }
    return json.dumps({**base, **changes})


def messages_input(good):
    return [c for c in good.columns if c not in ("topic", "partition", "offset")]


def test_packets_to_keyed_messages_and_back(spark, folder):
    path = write(folder, "packets.json", [packet(), "{broken", packet(payload_hex="zz"), packet(src_ip=None)])
    good, bad = topics.quarantine(topics.read_packets(spark, path))
    assert good.count() == 2
    assert sorted(r.reject_reason for r in bad.collect()) == ["bad_json", "missing_src_ip"]
    messages, dropped = jobs.packets_to_messages(good.select(*messages_input(good)))
    assert [r.reject_reason for r in dropped.collect()] == ["bad_hex"]
    topics.write_keyed(topics.message_records(messages), folder + "/out", topics.message_topic())
    row = spark.read.json(folder + "/out").first()
    assert (row.key, row.topic) == ("192.168.1.1:192.168.1.2:modbus", "ics.parsed.modbus")
    values = write(folder, "values.json", [row.value])
    back, _ = topics.quarantine(topics.read_messages(spark, values))
    flat = envelope.unnest_message(back)
    direct = envelope.flatten_envelope(messages)
    assert flat.first().asDict() == direct.first().asDict()
    assert features.extract_features(flat).count() == 3
    stored = jobs.packets_to_features(good.select(*messages_input(good)), store=folder + "/store")
    assert stored.count() == 3


def test_features_and_aliases(spark, folder):
    key = {"src_ip": "a", "dst_ip": "b", "protocol": "modbus", "window_size": 60, "window_start": 0}
    rows = [
        {"_window_key": key, "_extracted_at": "2024-01-01T00:00:00Z", "protocol": "modbus", "window_size_seconds": 60, "message_count": 3},
        {"window_key": {**key, "window_start": 60}, "extracted_at": "2024-01-01T00:00:00Z", "protocol": "modbus", "window_size_seconds": 60},
        {"window_key": key, "protocol": "modbus"},
    ]
    path = write(folder, "f.json", [json.dumps(r) for r in rows])
    good, bad = topics.quarantine(topics.read_features(spark, path))
    assert sorted(r.window_key.window_start for r in good.collect()) == [0, 60]
    assert [r.reject_reason for r in bad.collect()] == ["missing_extracted_at"]
    training, names = topics.read_training_features(spark, path, max_rows=1)
    assert training.count() == 1 and "message_count" in names and names == sorted(names)


def test_anomaly_ranges(spark, folder):
    key = {"src_ip": "a", "dst_ip": "b", "protocol": "modbus", "window_size": 60, "window_start": 0}
    row = {"window_key": key, "detected_at": "2024-01-01T00:00:00Z", "ensemble_score": 0.8, "classification": "anomaly", "confidence": 0.5, "surplus": 1}
    path = write(folder, "a.json", [json.dumps(row), json.dumps({**row, "ensemble_score": 1.2}), json.dumps({**row, "confidence": -1})])
    good, bad = topics.quarantine(topics.read_anomalies(spark, path))
    assert sorted(r.reject_reason for r in bad.collect()) == ["range_confidence", "range_ensemble_score"]
    flat = topics.flat_anomalies(good).first()
    assert (flat.src_ip, flat.detected_s, len(flat.anomaly_id)) == ("a", 1704067200, 64)


def test_feature_files(spark, folder):
    for name in ("a", "b"):
        Path(folder, f"{name}.json").write_text(json.dumps([{"protocol": "modbus", "message_count": 2}] * 2))
    Path(folder, "c.txt").write_text("[]")
    assert topics.read_feature_files(spark, folder).count() == 4
    with pytest.raises(FileNotFoundError):
        topics.read_feature_files(spark, folder, "*.nothing").count()


def test_labelled_sensor_table(spark, folder):
    path = write(folder, "s.csv", [
        "Timestamp, A1,B2,Normal/Attack",
        "28/12/2015 10:00:00 AM,1.5,,Normal",
        "28/12/2015 10:00:01 AM,,7,Attack",
        "28/12/2015 10:00:02 AM,,,Normal",
    ])
    frame = spark.read.csv(path, header=True)
    renamed = path + ".clean"
    frame.toDF(*[c.strip() for c in frame.columns]).write.option("header", True).csv(renamed)
    got = topics.load_labelled_process_csv(spark, renamed, ["A1", "B2"], span_s=1).orderBy("ts_s").collect()
    assert [(r.A1, r.B2, r.label) for r in got] == [(1.5, None, 0), (1.5, 7.0, 1), (1.5, 7.0, 0)]


def test_training_data_round_trip(spark, folder):
    frame = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    topics.save_training_data(frame, folder + "/p")
    topics.save_training_data(frame, folder + "/j", "json")
    assert spark.read.parquet(folder + "/p").columns == ["a", "b"]
    assert spark.read.json(folder + "/j").first().a == 1.0


def test_stream_of_packets_is_read_like_a_table(spark, folder):
    Path(folder, "in").mkdir()
    write(folder + "/in", "p.json", [packet(), packet(dst_port=20000)])
    stream, _ = topics.quarantine(topics.read_packets(spark, folder + "/in", streaming=True))
    query = (
        stream.withColumn("x", F.lit(1)).writeStream.format("parquet").option("checkpointLocation", folder + "/cp")
        .trigger(availableNow=True).start(folder + "/out")
    )
    query.awaitTermination(120)
    assert spark.read.parquet(folder + "/out").count() == 2

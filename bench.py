"""Time the headline jobs and print one JSON line.

Packets are built once, outside the timing, because the tables hold none; every other query
starts from the given tables. Results go to Spark's `noop` sink, so all rows are computed.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from catalog import alerting, features, packets, vectors, views
from tidegauge.operators import envelope
from tidegauge.operators import features as feature_ops
from tidegauge.operators.windows import assign_windows
from tidegauge.plans import jobs
from tidegauge.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def clocked(work) -> float:
    began = time.time()
    work()
    return time.time() - began


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    packets.labelled(spark, SF_DIR).repartition(int(CPUS)).write.parquet(f"{folder}/packets")
    stored = spark.read.parquet(f"{folder}/packets")
    kept, _ = envelope.route_by_protocol(stored)
    envelope.flatten_envelope(envelope.to_envelope(kept)).write.parquet(f"{folder}/messages")
    flat = spark.read.parquet(f"{folder}/messages")
    hours = features.feature_rows(spark, SF_DIR)
    hours.write.parquet(f"{folder}/vectors")
    hours = spark.read.parquet(f"{folder}/vectors")
    artifacts = jobs.train(hours, seed=1)[0]

    timed = {
        "decode_packets": (lambda: run(envelope.decode_packets(stored)), stored.count()),
        "volume_features": (
            lambda: run(feature_ops.volume_features(assign_windows(flat, views.SIZES))), flat.count()
        ),
        "extract_features": (lambda: run(feature_ops.extract_features(flat, views.SIZES)), flat.count()),
        "event_features": (lambda: run(features.feature_rows(spark, SF_DIR)), None),
        "score_features": (lambda: run(jobs.score_features(hours, artifacts)), hours.count()),
        "rolling_sequences": (lambda: run(vectors.rolling_sequences(spark, SF_DIR)), None),
        "correlate": (lambda: run(alerting.correlated(spark, SF_DIR)), None),
        "alerting": (
            lambda: run(alerting.handled(spark, SF_DIR)), views.anomalies(spark, SF_DIR).count()
        ),
        "escalate": (lambda: run(alerting.escalate_priority(spark, SF_DIR)), None),
    }
    seconds: dict[str, float] = {}
    rates: dict[str, float] = {}
    for name, (work, rows) in timed.items():
        work()  # once to compile
        seconds[name] = round(min(clocked(work) for _ in range(3)), 3)
        if rows:
            rates[name] = round(rows / seconds[name])
    print(json.dumps({
        "metric": "total seconds of the headline jobs",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_per_second": rates,
        "sf": SF_DIR.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()

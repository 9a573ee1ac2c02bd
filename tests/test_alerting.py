"""Incidents, suppression and escalation, against literal cases and a plain loop."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.text import escape_cef, relative_age
from tidegauge.operators import classify as cl
from tidegauge.operators import correlate as co
from tidegauge.operators import dedup, escalate, lifecycle
from tidegauge.plans import jobs
from tidegauge.sources import export

ANOMALY = (
    "anomaly_id bigint, src_ip string, dst_ip string, protocol string, window_size int, "
    "window_start bigint, detected_s bigint, ensemble_score double, classification string, "
    "anomaly_type string, confidence double, feature_contributions map<string,double>"
)
CLASS = {0.5: "suspicious", 0.8: "anomaly", 0.95: "critical"}


def anomalies(spark, rows):
    """Rows of (second, score, type, src, dst)."""
    data = []
    for i, (at, score, kind, src, dst) in enumerate(rows):
        data.append((i, src, dst, "modbus", 60, at - at % 60, at, score, CLASS[score], kind, 0.9,
                     {"a": 0.1, "b": -0.9, "c": 0.5, "d": 0.2, "e": 0.3, "f": 0.4}))
    return spark.createDataFrame(data, ANOMALY)


def simple(spark, seconds, score=0.8):
    return anomalies(spark, [(s, score, "reconnaissance", "10.0.0.1", "10.0.0.2") for s in seconds])


def test_gap_is_inclusive(spark):
    got = co.correlate(simple(spark, [0, 300, 601])).orderBy("detected_s").collect()
    assert [r.incident_seq for r in got] == [1, 2, 1]
    assert got[0].incident_id == got[1].incident_id != got[2].incident_id
    sessions = co.incident_sessions(simple(spark, [0, 300, 601])).orderBy("incident_started_s").collect()
    assert [(r.incident_started_s, r.last_s, r.anomaly_count) for r in sessions] == [(0, 300, 2), (601, 601, 1)]


def test_closing_an_incident_opens_a_new_one(spark):
    closures = spark.createDataFrame([("10.0.0.1:10.0.0.2:modbus", 10)], "correlation_key string, closed_s bigint")
    got = co.correlate(simple(spark, [0, 10, 11, 12]), closures=closures).orderBy("detected_s").collect()
    assert [r.incident_seq for r in got] == [1, 2, 1, 2]


def test_keys(spark):
    row = co.correlate(simple(spark, [0])).withColumn("dedup_key", co.dedup_key()).first()
    assert row.correlation_key == "10.0.0.1:10.0.0.2:modbus"
    assert row.dedup_key == "10.0.0.1:10.0.0.2:modbus:reconnaissance"
    untyped = anomalies(spark, [(0, 0.8, None, "a", "b")]).select(co.dedup_key()).first()[0]
    assert untyped == "a:b:modbus:None"


def test_rollup(spark):
    found = co.correlate(
        anomalies(spark, [(0, 0.5, "reconnaissance", "s", "d2"), (1, 0.8, "volume_anomaly", "s", "d1")]),
        key_columns=("src_ip", "protocol"),
    )
    row = co.incident_rollup(found, list_alerts=True).first()
    assert (row.anomaly_count, row.max_ensemble_score) == (2, 0.8)
    assert (row.dst_ips, row.anomaly_types) == (["d2", "d1"], ["reconnaissance", "volume_anomaly"])
    assert (row.multi_source, row.multi_target, len(row.alert_ids)) == (False, True, 2)
    assert row.title == "Multi-type Anomaly Incident (2 types)"


def plain_suppress(seconds, ttl):
    kept, lock = [], None
    for s in sorted(seconds):
        if lock is None or s >= lock:
            kept.append(s)
            lock = s + ttl
    return kept


def test_suppression(spark):
    found = co.to_alerts(co.correlate(simple(spark, [0, 10, 60, 61, 130])))
    got = dedup.suppress_duplicates(found, 60).filter(~F.col("suppressed")).orderBy("detected_s")
    assert [r.detected_s for r in got.collect()] == [0, 60, 130]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suppression_against_a_plain_loop(spark, seed):
    rng = np.random.default_rng(seed)
    keys = {}
    for k in range(12):
        span = int(rng.choice([300, 5000, 40000]))
        keys[f"k{k}"] = sorted(int(x) for x in rng.integers(0, span, int(rng.choice([5, 100, 800]))))
    rows = [(k, s, i) for k, all_s in keys.items() for i, s in enumerate(all_s)]
    frame = spark.createDataFrame(rows, "dedup_key string, detected_s bigint, anomaly_id bigint")
    for ttl in (1, 60, 333):
        marked = dedup.suppress_duplicates(frame, ttl).filter(~F.col("suppressed")).collect()
        got = {}
        for r in marked:
            got.setdefault(r.dedup_key, []).append(r.detected_s)
        assert {k: sorted(v) for k, v in got.items()} == {k: plain_suppress(v, ttl) for k, v in keys.items()}


@pytest.mark.parametrize("span", [2, 3, 128])
def test_long_runs_with_releases_against_a_plain_loop(spark, monkeypatch, span):
    """Unbroken runs over many blocks: the tables are composed, and the entries come back down the levels."""
    monkeypatch.setattr(dedup, "SPAN", span)
    rng = np.random.default_rng(span)
    keys = {f"k{k}": sorted({int(x) for x in rng.integers(-3000, 9000, n)}) for k, n in enumerate((30, 400, 2000, 6000))}
    freed = {k: sorted(int(x) for x in rng.integers(-3100, 9100, 40)) for k in list(keys)[1:]}
    rows = [(k, s, i) for k, all_s in keys.items() for i, s in enumerate(all_s)]
    frame = spark.createDataFrame(rows, "dedup_key string, detected_s bigint, anomaly_id bigint")
    releases = spark.createDataFrame(
        [(k, r) for k, all_r in freed.items() for r in all_r], "dedup_key string, released_s bigint"
    )
    for ttl, given in ((7, None), (60, releases), (45, releases)):
        expected = set()
        for key, seconds in keys.items():
            lock = None
            for s in seconds:
                if lock is None or s >= lock:
                    expected.add((key, s))
                    after = [max(r, s + 1) for r in freed.get(key, []) if r >= s] if given is not None else []
                    lock = min([s + ttl, *after])
        marked = dedup.suppress_duplicates(frame, ttl, releases=given).filter(~F.col("suppressed"))
        assert {(r.dedup_key, r.detected_s) for r in marked.collect()} == expected


def test_closures_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(int(s), 0.8, "timing_anomaly", f"s{i % 3}", "d") for i, s in enumerate(rng.integers(0, 20000, 500))]
    frame = anomalies(spark, rows)
    keyed = frame.withColumn("correlation_key", co.correlation_key())
    names = [r.correlation_key for r in keyed.select("correlation_key").distinct().collect()]
    closed = {names[0]: sorted(int(x) for x in rng.integers(0, 20000, 60)), names[1]: [100, 100, 4000]}
    closures = spark.createDataFrame(
        [(k, c) for k, all_c in closed.items() for c in all_c], "correlation_key string, closed_s bigint"
    )
    got = {r.anomaly_id: (r.incident_started_s, r.incident_seq) for r in co.correlate(frame, 300, closures=closures).collect()}
    expected, open_ = {}, {}
    for r in sorted(keyed.collect(), key=lambda r: (r.detected_s, r.anomaly_id)):
        era = sum(c < r.detected_s for c in closed.get(r.correlation_key, []))
        started, last, n, before = open_.get(r.correlation_key, (None, None, 0, None))
        if last is None or r.detected_s - last > 300 or era != before:
            started, n = r.detected_s, 0
        open_[r.correlation_key] = (started, r.detected_s, n + 1, era)
        expected[r.anomaly_id] = (started, n + 1)
    assert got == expected


def test_a_release_frees_the_key(spark):
    found = co.to_alerts(co.correlate(simple(spark, [0, 10, 20, 30, 90])))
    releases = found.filter(F.col("detected_s") == 10).select("dedup_key", F.lit(15).cast("bigint").alias("released_s"))
    got = dedup.suppress_duplicates(found, 60, releases=releases).filter(~F.col("suppressed"))
    assert sorted(r.detected_s for r in got.collect()) == [0, 20, 90]


@pytest.mark.parametrize(("count", "expected"), [(2, "P4"), (5, "P3"), (10, "P2"), (20, "P1")])
def test_count_thresholds(spark, count, expected):
    frame = spark.createDataFrame([(count, "medium", 1)], "n int, s string, t int")
    rank = escalate.incident_rank(F.col("n"), F.col("s"), F.col("t"), escalate.Escalation())
    assert frame.select(escalate.priority_name(rank)).first()[0] == expected


def test_severity_and_target_rules(spark):
    frame = spark.createDataFrame([(1, "critical", 1), (3, "medium", 3)], "n int, s string, t int")
    on = escalate.incident_rank(F.col("n"), F.col("s"), F.col("t"), escalate.Escalation())
    off = escalate.incident_rank(
        F.col("n"), F.col("s"), F.col("t"), escalate.Escalation(critical_severity=False, multi_target=False)
    )
    assert [tuple(r) for r in frame.select(on, off).collect()] == [(2, 4), (2, 4)]


def plain_priorities(rows, gap, ttl):
    """Rows of (second, id, score, type): incident start, number, suppressed and priority."""
    out, last, locks = {}, None, {}
    for at, i, score, kind in rows:
        if last is None or at - last > gap:
            start, n, rank = at, 0, 4
        last, n = at, n + 1
        suppressed = at < locks.get(kind, -1)
        if not suppressed:
            locks[kind] = at + ttl
            rank = min(rank, 1 if n >= 20 else 2 if n >= 10 else 3 if n >= 5 else 4)
            if score >= 0.9:
                rank = min(rank, 2)
        out[i] = (start, n, suppressed, f"P{rank}")
    return out


def test_whole_alerting_against_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    at, rows = 0, []
    for _ in range(600):
        at += int(rng.choice([0, 1, 7, 40, 120, 301], p=[0.1, 0.3, 0.3, 0.15, 0.1, 0.05]))
        kind = str(rng.choice(["reconnaissance", "volume_anomaly", "timing_anomaly"]))
        rows.append((at, float(rng.choice([0.5, 0.8, 0.95], p=[0.5, 0.47, 0.03])), kind, "s", "d"))
    alerts, incidents, events = jobs.alerting(anomalies(spark, rows), 300, 60)
    got = {
        r.anomaly_id: (r.incident_started_s, r.incident_seq, r.suppressed, r.priority) for r in alerts.collect()
    }
    expected = plain_priorities([(r[0], i, r[1], r[2]) for i, r in enumerate(rows)], 300, 60)
    assert got == expected
    final = {}
    for start, _, _, priority in expected.values():
        final[start] = min(final.get(start, "P4"), priority)
    assert {r.created_s: r.priority for r in incidents.collect()} == final
    changes = 0
    for start in final:
        levels = [p for s, _, _, p in expected.values() if s == start]
        changes += len(set(["P4", *levels])) - 1
    assert events.count() == changes


def test_a_store_changes_nothing(spark, folder):
    frame = simple(spark, [0, 10, 60, 61, 130, 900])
    direct, stored = jobs.alerting(frame), jobs.alerting(frame, store=folder)
    for one, two in zip(direct, stored):
        assert sorted(map(str, one.collect())) == sorted(map(str, two.select(*one.columns).collect()))


def test_a_suppressed_critical_alert_does_not_escalate(spark):
    rows = [(0, 0.8, "reconnaissance", "s", "d"), (5, 0.95, "reconnaissance", "s", "d")]
    alerts, incidents, events = jobs.alerting(anomalies(spark, rows))
    assert [r.priority for r in alerts.collect()] == ["P4", "P4"]
    assert incidents.first().anomaly_count == 2 and events.count() == 0


def test_classes(spark):
    scores = [0.1, 0.4, 0.5, 0.7, 0.75, 0.9, 0.95]
    frame = spark.createDataFrame([(s,) for s in scores], "s double")
    assert [r[0] for r in frame.select(cl.classify(F.col("s"))).collect()] == [
        "normal", "suspicious", "suspicious", "anomaly", "anomaly", "critical", "critical",
    ]


def test_types_and_contributions(spark):
    frame = spark.createDataFrame(
        [(0.01, 0.5, 0.0001, 2.0, 50, 5000, 0.0, 100.0), (0.1, 0.01, 0.0, 0.0, 5000, 2000000, 1000.0, 400.0)],
        "iat_mean double, iat_std double, iat_min double, iat_max double, message_count int, "
        "bytes_total int, bytes_std double, bytes_mean double",
    )
    kinds = [r[0] for r in frame.select(cl.identify_type(F.lit("anomaly"))).collect()]
    assert kinds == ["timing_anomaly", "volume_anomaly"]
    assert frame.select(cl.identify_type(F.lit("normal"))).first()[0] is None
    ab = spark.createDataFrame([(7.0, 60.0)], "a double, b double")
    parts = ab.select(cl.feature_contributions({"a": (5.0, 1.0), "b": (50.0, 10.0)})).first()[0]
    assert parts["a"] == pytest.approx(2 / 3) and parts["b"] == pytest.approx(1 / 3)


def test_texts(spark):
    alert = co.to_alerts(co.correlate(simple(spark, [0], 0.95))).first()
    assert (alert.severity, alert.title) == ("critical", "Reconnaissance detected from 10.0.0.1")
    lines = alert.description.split("\n")
    assert lines[0] == "Anomaly detected in MODBUS traffic" and lines[7] == "  Top Features:"
    assert lines[8:] == ["    - b: -0.900", "    - c: 0.500", "    - f: 0.400", "    - e: 0.300", "    - d: 0.200"]
    plain = co.to_alerts(co.correlate(anomalies(spark, [(0, 0.5, None, "s", "d")]))).first()
    assert (plain.severity, plain.title) == ("low", "Suspicious MODBUS traffic from s")


def test_status_and_listing(spark):
    found = co.to_alerts(co.correlate(simple(spark, [0, 10, 20])))
    first = found.orderBy("detected_s").first().alert_id
    updates = spark.createDataFrame(
        [(first, "acknowledged", 5), (first, "resolved", 9), ("nobody", "resolved", 1)],
        "id string, status string, at_s bigint",
    )
    updated, missing = lifecycle.apply_status(found, updates, "alert_id")
    assert {r.detected_s: r.status for r in updated.collect()} == {0: "resolved", 10: "open", 20: "open"}
    assert [r.id for r in missing.collect()] == ["nobody"]
    assert [r.detected_s for r in lifecycle.list_alerts(updated, "open", limit=1).collect()] == [20]
    incidents = co.incident_rollup(found)
    moved, _ = lifecycle.apply_status(
        incidents, updates.limit(1).withColumn("id", F.lit(incidents.first().incident_id)).withColumn("at_s", F.lit(99)),
        "incident_id", moves_updated=True,
    )
    assert (moved.first().status, moved.first().updated_s) == ("acknowledged", 99)


def test_prior_context_against_a_plain_loop(spark):
    rng = np.random.default_rng(9)
    seconds = sorted(int(s) for s in rng.integers(0, 3000, 200))
    rows = [(s, float(rng.choice([0.5, 0.8])), "x", "s", "d") for s in seconds]
    got = {
        r.anomaly_id: (r.prior_alerts, r.prior_best)
        for r in lifecycle.prior_alert_context(anomalies(spark, rows), 100).collect()
    }
    for i, (at, *_) in enumerate(rows):
        before = [r[1] for r in rows if at - 100 <= r[0] < at]
        assert got[i] == (len(before), max(before, default=None))


def test_prior_context_work_grows_with_the_seconds(spark):
    """One busy asset with an alert every second: a frame summed anew for every second would take minutes."""
    n, lookback = 400_000, 100_000
    rows = spark.range(n).select(
        F.lit("d").alias("dst_ip"), F.col("id").alias("detected_s"), (-F.col("id") / n).alias("ensemble_score")
    )
    started = time.monotonic()
    found = lifecycle.prior_alert_context(rows, lookback).agg(
        F.count_if(F.col("prior_alerts") != F.least("detected_s", F.lit(lookback))),
        F.count_if(~F.col("prior_best").eqNullSafe(
            F.when(F.col("detected_s") > 0, -F.greatest(F.col("detected_s") - lookback, F.lit(0)) / n)
        )),
        F.count("*"),
    ).first()
    assert tuple(found) == (0, 0, n)
    assert time.monotonic() - started < 60


def test_risk_of_a_busy_asset_over_a_day(spark):
    """Earlier alerts of a whole day count, and their number does not make the look-back slow."""
    n, day = 300_000, 86_400
    rows = spark.range(n).select(
        F.lit("d").alias("dst_ip"), F.col("id").alias("detected_s"), F.lit(0.5).alias("ensemble_score"),
        F.lit("reconnaissance").alias("anomaly_type"),
    )
    assets = spark.createDataFrame([("d", 5)], "ip string, importance int")
    started = time.monotonic()
    known = lifecycle.prior_alert_context(rows, day)
    risk = 0.2 + 0.3 + 0.15 + 0.1 * F.least("detected_s", F.lit(day)) / day
    wrong = cl.risk_severity(known, assets, repeat_limit=day).filter(F.abs(F.col("risk") - risk) > 1e-9)
    assert wrong.count() == 0
    assert time.monotonic() - started < 60


def test_prior_context_of_missing_and_repeated_values(spark):
    rows = [(None, 5, 0.9), ("a", None, 0.9), ("a", 5, None), ("a", 5, 0.2), ("a", 9, 0.4), ("a", 15, 0.1), ("a", 25, 0.1), ("b", -3, 0.3), ("b", 7, 0.1)]
    frame = spark.createDataFrame(rows, "dst_ip string, detected_s bigint, ensemble_score double")
    got = {(r.dst_ip, r.detected_s, r.ensemble_score): (r.prior_alerts, r.prior_best) for r in lifecycle.prior_alert_context(frame, 10).collect()}
    assert got == {
        (None, 5, 0.9): (None, None), ("a", None, 0.9): (None, None), ("a", 5, None): (0, None), ("a", 5, 0.2): (0, None),
        ("a", 9, 0.4): (2, 0.2), ("a", 15, 0.1): (3, 0.4), ("a", 25, 0.1): (1, 0.1), ("b", -3, 0.3): (0, None), ("b", 7, 0.1): (1, 0.3),
    }


def test_ages_and_escapes(spark):
    frame = spark.createDataFrame([(0,), (100 - 61,), (-4000,), (-200000,)], "t bigint")
    ages = [r[0] for r in frame.select(relative_age(F.col("t"), 59)).collect()]
    assert ages == ["59s ago", "20s ago", "1h ago", "2d ago"]
    text = spark.createDataFrame([("a\\b=c\nd",)], "t string").select(escape_cef(F.col("t"))).first()[0]
    assert text == "a\\\\b\\=c\\nd"


def test_cef_line(spark):
    found = co.to_alerts(co.correlate(simple(spark, [1704110400], 0.95)))
    row = export.format_cef(found, export.Sender(vendor="V", product="P", host="h")).first()
    assert row.cef.startswith("CEF:0|V|P|1.0|ICS-CRITICAL|Reconnaissance detected from 10.0.0.1|10|src=10.0.0.1 dst=")
    assert row.syslog.startswith("<130>Jan 01 12:00:00 h ics-alerting: CEF:0|")


def test_an_incident_with_many_addresses_stays_a_small_row(spark):
    rows = spark.range(30_000).select(
        F.lit("k").alias("correlation_key"), F.lit("i").alias("incident_id"), F.lit("s").alias("src_ip"),
        F.format_string("d%05d", F.col("id")).alias("dst_ip"), F.lit("reconnaissance").alias("anomaly_type"),
        (30_000 - F.col("id")).alias("detected_s"), F.col("id").alias("anomaly_id"), F.lit(0.5).alias("ensemble_score"),
        F.col("id").alias("incident_seq"),
    )
    row = co.incident_rollup(rows, listed=7).first()
    assert row.dst_ips == [f"d{n:05d}" for n in range(29_999, 29_992, -1)] and row.dst_ips_count == 30_000
    assert (row.src_ips, row.multi_source, row.multi_target, row.anomaly_types_count) == (["s"], False, True, 1)
    members = co.incident_members(rows)
    assert members.count() == 30_002 and members.filter("kind = 'src_ips'").first().alerts == 30_000
    plan = co.incident_rollup(rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_hosts_beyond_the_lists_count_in_the_summary(spark):
    from tidegauge.operators import reports

    rows = [("i1", "src_ips", "a"), ("i1", "dst_ips", "b"), ("i2", "src_ips", "a"), ("i2", "dst_ips", "c"), ("i2", "dst_ips", "b")]
    members = spark.createDataFrame(rows, "incident_id string, kind string, value string")
    incidents = spark.createDataFrame([("i1", "P3"), ("i2", "P1")], "incident_id string, priority string")
    got = sorted(tuple(r) for r in reports.host_incident_summary(incidents, 1, members).collect())
    assert got == [("a", 2, "P1", "source"), ("b", 2, "P1", "destination")]

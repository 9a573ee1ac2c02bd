"""Drift over all window sizes and features, against a plain two-sample statistic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog import vectors
from catalog.features import feature_rows
from tidegauge.operators import prep

SF = "/root/testdata/sf0.001"


def statistic(a, b):
    a, b = np.sort(a), np.sort(b)
    at = np.concatenate([a, b])
    return np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()


def test_all_windows_and_features(spark):
    rows = feature_rows(spark, SF)
    names = prep.feature_names(rows)
    table = rows.select("window_start", *[F.col(n).cast("double").alias(n) for n in names]).collect()
    found = {r["feature"]: r for r in vectors.ks_drift_all(spark, SF).collect()}
    sides = {n: [[r[n] for r in table if r[n] is not None and (r["window_start"] < 1705276800) == early] for early in (True, False)] for n in names}
    want = {n: statistic(*s) for n, s in sides.items() if s[0] and s[1]}
    assert len(want) > 40 and set(want) <= set(found) <= set(names)
    assert all(abs(found[n]["ks_statistic"] - d) < 0.0011 for n, d in want.items())
    assert max(len(s[0]) + len(s[1]) for s in sides.values()) == len(table)
    fired = any(r["drift_detected"] for r in found.values())
    summary = vectors.drift_summary_all(spark, SF).first()
    assert summary["total_features"] == len(found) and (summary["drifted_features"] > 0) == fired
    print("FOUND", len(found), summary["drifted_features"], len(table))
    assert vectors.retrain_triggers_all(spark, SF).first()["drift"] == fired

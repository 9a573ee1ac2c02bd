"""Rows and digits that must not get lost."""

from __future__ import annotations

import json

import numpy as np

from tidegauge.functions.ordered import exact_quantiles, forward_fill
from tidegauge.functions.text import joined_key
from tidegauge.operators.envelope import unnest_message
from tidegauge.sources import topics


def test_quantiles_of_close_values_per_group(spark):
    rng = np.random.default_rng(3)
    groups = {"a": 0.99 + 0.001 * rng.random(500), "b": np.array([0.5]), None: np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("b", None), ("c", None)]
    found = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", {"p": 0.95}, ["g"])
    got = {r["g"]: (r["p"], r["samples"]) for r in found.collect()}
    assert set(got) == set(groups)
    for g in groups:
        assert abs(got[g][0] - np.quantile(groups[g], 0.95)) < 1e-12 and got[g][1] == len(groups[g])


def test_forward_fill_keeps_rows_without_time_or_group(spark):
    rows = [("x", 1, 5.0), ("x", 200, None), ("x", None, None), (None, 1, 7.0), (None, 300, None)]
    frame = spark.createDataFrame(rows, "source string, t long, v double")
    got = sorted(map(tuple, forward_fill(frame, ["v"], ["source"], "t", 100).collect()), key=str)
    assert got == sorted([("x", 1, 5.0), ("x", 200, 5.0), ("x", None, None), (None, 1, 7.0), (None, 300, 7.0)], key=str)


def test_messages_without_a_time_take_their_arrival(spark, tmp_path):
    body = {"src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "protocol": "modbus", "message": {"function_code": 3}}
    lines = [body | {"timestamp": t} for t in ("2024-01-01T00:00:00Z", "junk", None)]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, lines)))
    good, bad = topics.quarantine(topics.read_messages(spark, str(tmp_path)))
    flat = unnest_message(good).collect()
    assert bad.count() == 0 and [r["ts_us"] is None for r in flat] == [False] * 3
    assert sorted(r["has_time"] for r in flat) == [False, False, True]


def test_keys_with_absent_parts_differ(spark):
    rows = spark.createDataFrame([("a", None, "b"), (None, "a", "b")], "x string, y string, z string")
    assert len({r[0] for r in rows.select(joined_key("x", "y", "z")).collect()}) == 2

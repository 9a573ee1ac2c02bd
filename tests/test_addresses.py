"""New register addresses against bitmaps of the known ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import addresses
from tidegauge.operators import classify as cl

SCHEMA = "src_ip string, dst_ip string, protocol string, ts_us bigint, function_code int, start_address int, quantity int"


def frame(spark, rows):
    return spark.createDataFrame([("a", "b", "modbus", s * 1_000_000, *rest) for s, *rest in rows], SCHEMA)


def test_runs_edges_of_bitmaps_and_unknown_flows(spark):
    rows = [(0, 16, 0, 3), (1, 6, 32767, 9), (2, 15, 32768, 1), (3, 16, 65530, 4), (4, 3, 100, 10), (5, 6, None, 1)]
    rows += [(100, 16, 1, 4), (101, 6, 32767, 1), (102, 6, 32768, None), (103, 6, 32769, 1), (104, 16, 65533, 2), (105, 6, 100, 1)]
    messages = frame(spark, rows)
    baseline = addresses.address_baseline(messages, 60)
    got = {r.window_start: r.new_write_addresses for r in addresses.new_addresses(messages, baseline, (60,)).collect()}
    # 3, 4, 32769, 65534 and 100 are new; reads do not make an address known
    assert got == {0: 0, 60: 5}
    everything = addresses.address_baseline(messages, 60, writes_only=False)
    found = addresses.new_addresses(messages, everything, (60,), writes_only=False, name="new_addresses")
    assert {r.window_start: r.new_addresses for r in found.collect()} == {0: 0, 60: 3}
    other = messages.withColumn("src_ip", F.lit("z"))
    assert sorted(r.new_write_addresses for r in addresses.new_addresses(other, baseline, (60,)).collect()) == [9, 10]


def test_baselines_of_periods_merge(spark):
    messages = frame(spark, [(n, 6, n * 700, 1) for n in range(90)])
    whole = addresses.address_baseline(messages, 1000)
    parts = [addresses.address_baseline(messages.filter(F.col("ts_us") % 2_000_000 == r * 1_000_000), 1000) for r in (0, 1)]
    merged = addresses.merge_baselines(*parts)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 2


def test_the_rule(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.1, 2), (0.9, 0)], "fc_write_ratio double, new_write_addresses long")
    kinds = {"command_injection": cl.RULES["command_injection"]}
    judged = rows.select(cl.rule_type(kinds, addresses=("new_write_addresses",)).alias("t"), cl.rule_type(kinds).alias("plain"))
    assert sorted(map(tuple, judged.collect())) == [
        ("command_injection", "command_injection"), ("command_injection", "unknown"), ("unknown", "unknown")]

"""The rule queries see the windows of every protocol; their SQL twins are compared in test_catalog."""

from __future__ import annotations

from catalog import classify
from catalog.features import feature_rows

SF = "/root/testdata/sf0.001"


def test_every_window_has_a_type(spark):
    want = {r["protocol"]: r["count"] for r in feature_rows(spark, SF).groupBy("protocol").count().collect()}
    found = classify.rule_type_all(spark, SF).groupBy("protocol").count().collect()
    assert {r["protocol"]: r["count"] for r in found} == want and set(want) == {"modbus", "dnp3", "opcua"}
    counted = classify.rule_technique_all(spark, SF).collect()
    assert sum(r["n"] for r in counted) == sum(want.values())
    print("WINDOWS", want)

"""Classification and explanation over feature rows and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.features import GAPS_SQL, MODBUS_SQL, feature_rows
from catalog.registry import query
from catalog.views import (
    ANOMALIES_SQL,
    CORRELATED_SQL,
    GROUP_SQL,
    KEY_SQL,
    SIZES,
    SIZES_SQL,
    WINDOWED_SQL,
    anomalies,
    comparable,
    messages,
    table,
)
from tidegauge.functions import names
from tidegauge.operators import addresses
from tidegauge.operators import classify as cl
from tidegauge.operators.windows import WINDOW

CORE_SQL = WINDOWED_SQL + GAPS_SQL + f""",
core AS (
  SELECT {GROUP_SQL}, count(*) AS n, sum(payload_size) AS b, avg(payload_size) AS bm,
         stddev_pop(payload_size) AS bs
  FROM windowed GROUP BY {GROUP_SQL}),
scored AS (
  SELECT *, CASE WHEN iat_mean < 1e-10 THEN 0 ELSE least(1, iat_std / iat_mean * 0.5
              + least((iat_max - iat_min) / iat_mean, 10) / 20) END AS ts,
         least(1, CASE WHEN n > 1000 THEN 0.4 WHEN n < 5 THEN 0.2 ELSE 0 END
           + CASE WHEN b > 1000000 THEN 0.3 ELSE 0 END + CASE WHEN bs > 500 THEN 0.3 ELSE 0 END) AS vs,
         least(1, CASE WHEN n > 100 AND bm < 50 THEN 0.5 ELSE 0 END
           + CASE WHEN iat_mean > 0 AND iat_std / greatest(iat_mean, 1e-10) < 0.1 THEN 0.3 ELSE 0 END
           + CASE WHEN n > 500 THEN 0.2 ELSE 0 END) AS rs
  FROM core JOIN timing USING ({GROUP_SQL}))
"""


@query(f"""
WITH {CORE_SQL}
SELECT {KEY_SQL}, round(ts, 3) AS timing_score, round(CAST(vs AS DOUBLE), 3) AS volume_score,
       round(CAST(rs AS DOUBLE), 3) AS recon_score,
       CASE WHEN n % 7 = 0 THEN NULL WHEN greatest(ts, vs, rs) < 0.3 THEN 'unknown'
            WHEN ts >= vs AND ts >= rs THEN 'timing_anomaly' WHEN vs >= rs THEN 'volume_anomaly'
            ELSE 'reconnaissance' END AS anomaly_type
FROM scored""")
def identify_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three heuristics and the type they give; counts divisible by 7 are taken as normal."""
    normal = F.when(F.col("message_count") % 7 == 0, "normal").otherwise("anomaly")
    return comparable(
        feature_rows(spark, sf_dir).select(
            *WINDOW,
            cl.timing_score().alias("timing_score"),
            cl.volume_score().alias("volume_score"),
            cl.recon_score().alias("recon_score"),
            cl.identify_type(normal).alias("anomaly_type"),
        )
    )


@query(f"""
WITH {ANOMALIES_SQL}
SELECT anomaly_id, CASE WHEN s >= 0.9 THEN 'critical' WHEN s >= 0.7 THEN 'anomaly'
         WHEN s >= 0.4 THEN 'suspicious' ELSE 'normal' END AS class,
       CASE WHEN s >= 0.8 THEN 'critical' WHEN s >= 0.5 THEN 'anomaly'
         WHEN s >= 0.3 THEN 'suspicious' ELSE 'normal' END AS strict_class
FROM (SELECT anomaly_id, ensemble_score AS s FROM anomalies)""")
def classify_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default thresholds, and stricter ones."""
    score = F.col("ensemble_score")
    return anomalies(spark, sf_dir).select(
        "anomaly_id", cl.classify(score).alias("class"),
        cl.classify(score, 0.3, 0.5, 0.8).alias("strict_class"),
    )


@query(f"""
WITH {ANOMALIES_SQL} SELECT anomaly_id, classification FROM anomalies WHERE classification <> 'normal'""")
def drop_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.operators.correlate import drop_normal as drop

    return drop(anomalies(spark, sf_dir)).select("anomaly_id", "classification")


@query(f"""
WITH rows AS ({MODBUS_SQL})
SELECT {KEY_SQL}, CASE
    WHEN fc_write_ratio > 0.5 THEN 'command_injection'
    WHEN exception_ratio > 0.10 OR exception_count > 10 THEN 'protocol_violation'
    WHEN addr_unique_count > 100 OR unit_id_unique_count > 10 THEN 'unauthorized_access'
    WHEN fc_read_ratio > 0.95 AND qty_mean > 50 THEN 'data_exfiltration'
    WHEN fc_unique_count > 10 OR addr_range > 1000 OR fc_diagnostic_ratio > 0.5 THEN 'reconnaissance'
    WHEN bytes_max > 1024 THEN 'volume_anomaly'
    WHEN iat_std > 1.0 OR iat_max > 10 THEN 'timing_anomaly' ELSE 'unknown' END AS rule_type
FROM rows""")
def rule_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight-way rule table on Modbus windows."""
    rows = feature_rows(spark, sf_dir).filter(F.col("protocol") == "modbus")
    return comparable(rows.select(*WINDOW, cl.rule_type().alias("rule_type")))


@query("WITH " + WINDOWED_SQL + GAPS_SQL + f""",
volume AS (
  SELECT {GROUP_SQL}, count(*) AS n, sum(payload_size) AS b, max(payload_size) AS top
  FROM windowed GROUP BY {GROUP_SQL}),
usual AS (
  SELECT src_ip, dst_ip, protocol, window_size, avg(n) AS n0, avg(b) AS b0
  FROM volume GROUP BY src_ip, dst_ip, protocol, window_size)
SELECT {KEY_SQL}, CASE WHEN top > 1024 OR n > 2 * n0 OR b > 3 * b0 THEN 'volume_anomaly'
    WHEN iat_std > 1.0 OR iat_max > 10 OR abs(n - n0) > 0.5 * n0 THEN 'timing_anomaly'
    ELSE 'unknown' END AS rule_type
FROM volume JOIN timing USING ({GROUP_SQL}) JOIN usual USING (src_ip, dst_ip, protocol, window_size)""")
def rule_type_by_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and timing rules of all protocols, with the cut-offs relative to the flow's baseline."""
    rows = feature_rows(spark, sf_dir)
    rules = {kind: cl.RULES[kind] for kind in ("volume_anomaly", "timing_anomaly")}
    judged = cl.with_baseline(rows, cl.flow_baseline(rows))
    return comparable(judged.select(*WINDOW, cl.rule_type(rules, relative=True).alias("rule_type")))


BASELINE_UNTIL = 1705276800  # 2024-01-15: what a flow touched before is its baseline

NEW_ADDRESSES_SQL = WINDOWED_SQL + f""",
touched AS (
  SELECT src_ip, dst_ip, protocol, ts_us, unnest(range(start_address, start_address +
           CASE WHEN function_code IN (15, 16) THEN greatest(quantity, 1) ELSE 1 END)) AS address
  FROM messages WHERE protocol = 'modbus' AND function_code IN ({", ".join(map(str, names.MODBUS_WRITE))})),
known AS (SELECT DISTINCT src_ip, dst_ip, protocol, address FROM touched WHERE ts_us < {BASELINE_UNTIL * 1_000_000}),
seen AS (
  SELECT DISTINCT src_ip, dst_ip, protocol, s.window_size,
         ts_us // 1000000 - (ts_us // 1000000) % s.window_size AS window_start, address
  FROM touched CROSS JOIN (VALUES {SIZES_SQL}) s(window_size)),
fresh AS (
  SELECT {GROUP_SQL}, count_if(k.address IS NULL) AS new_write_addresses
  FROM seen LEFT JOIN known k USING (src_ip, dst_ip, protocol, address) GROUP BY {GROUP_SQL})
"""


@query(f"WITH {NEW_ADDRESSES_SQL} SELECT {KEY_SQL}, CAST(new_write_addresses AS BIGINT) AS new_write_addresses FROM fresh")
def new_write_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses written in each window that the flow had not written before mid-January."""
    return comparable(_new_addresses(spark, sf_dir))


def _new_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = messages(spark, sf_dir)
    return addresses.new_addresses(found, addresses.address_baseline(found, BASELINE_UNTIL), SIZES)


@query(f"""
WITH {NEW_ADDRESSES_SQL},
writes AS (
  SELECT {GROUP_SQL}, count_if(function_code IN ({", ".join(map(str, names.MODBUS_WRITE))})) / count(*) AS share
  FROM windowed WHERE protocol = 'modbus' GROUP BY {GROUP_SQL})
SELECT {KEY_SQL}, CASE WHEN share > 0.5 OR coalesce(new_write_addresses, 0) > 0 THEN 'command_injection' ELSE 'unknown' END
         AS rule_type
FROM writes LEFT JOIN fresh USING ({GROUP_SQL})""")
def rule_type_new_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command injection by the share of writes or by writes to addresses the baseline lacks."""
    rows = feature_rows(spark, sf_dir).filter(F.col("protocol") == "modbus")
    judged = addresses.with_new_addresses(rows, _new_addresses(spark, sf_dir))
    rules = {"command_injection": cl.RULES["command_injection"]}
    return comparable(judged.select(*WINDOW, cl.rule_type(rules, addresses=("new_write_addresses",)).alias("rule_type")))


@query(f"""
WITH rows AS ({MODBUS_SQL}),
typed AS (
  SELECT CASE
    WHEN fc_write_ratio > 0.5 THEN 'command_injection'
    WHEN exception_ratio > 0.10 OR exception_count > 10 THEN 'protocol_violation'
    WHEN addr_unique_count > 100 OR unit_id_unique_count > 10 THEN 'unauthorized_access'
    WHEN fc_read_ratio > 0.95 AND qty_mean > 50 THEN 'data_exfiltration'
    WHEN fc_unique_count > 10 OR addr_range > 1000 OR fc_diagnostic_ratio > 0.5 THEN 'reconnaissance'
    WHEN bytes_max > 1024 THEN 'volume_anomaly'
    WHEN iat_std > 1.0 OR iat_max > 10 THEN 'timing_anomaly' ELSE 'unknown' END AS kind
  FROM rows)
SELECT kind, CASE kind WHEN 'command_injection' THEN 'T0831 - Manipulation of Control'
    WHEN 'protocol_violation' THEN 'T0855 - Unauthorized Command Message'
    WHEN 'unauthorized_access' THEN 'T0821 - Modify Controller Tasking'
    WHEN 'data_exfiltration' THEN 'T0882 - Theft of Operational Information'
    WHEN 'reconnaissance' THEN 'T0846 - Remote System Discovery'
    WHEN 'timing_anomaly' THEN 'T0882 - Theft of Operational Information' END AS technique, count(*) AS n
FROM typed GROUP BY ALL""")
def rule_technique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The technique of each type the rules find on Modbus windows, and how many windows have it."""
    rows = feature_rows(spark, sf_dir).filter(F.col("protocol") == "modbus").select(cl.rule_type().alias("kind"))
    return comparable(
        rows.groupBy("kind", cl.mitre_technique(F.col("kind")).alias("technique")).agg(F.count(F.lit(1)).alias("n"))
    )


# Modbus windows by all rules; of the other columns rules look at, DNP3 windows have the function codes' alone, OPC-UA none
ALL_TYPED_SQL = "WITH " + WINDOWED_SQL + GAPS_SQL + f""",
rows AS ({MODBUS_SQL}),
others AS (
  SELECT {GROUP_SQL}, max(payload_size) AS top,
    CASE WHEN protocol = 'dnp3' THEN count_if(dnp3_code IN (2, 3, 4, 5, 6)) / count(*) END AS wr,
    CASE WHEN protocol = 'dnp3' THEN count(DISTINCT dnp3_code) END AS codes
  FROM windowed WHERE protocol <> 'modbus' GROUP BY {GROUP_SQL}),
typed AS (
  SELECT {KEY_SQL}, CASE
    WHEN fc_write_ratio > 0.5 THEN 'command_injection'
    WHEN exception_ratio > 0.10 OR exception_count > 10 THEN 'protocol_violation'
    WHEN addr_unique_count > 100 OR unit_id_unique_count > 10 THEN 'unauthorized_access'
    WHEN fc_read_ratio > 0.95 AND qty_mean > 50 THEN 'data_exfiltration'
    WHEN fc_unique_count > 10 OR addr_range > 1000 OR fc_diagnostic_ratio > 0.5 THEN 'reconnaissance'
    WHEN bytes_max > 1024 THEN 'volume_anomaly'
    WHEN iat_std > 1.0 OR iat_max > 10 THEN 'timing_anomaly' ELSE 'unknown' END AS kind
  FROM rows
  UNION ALL
  SELECT {KEY_SQL}, CASE WHEN wr > 0.5 THEN 'command_injection' WHEN codes > 10 THEN 'reconnaissance'
    WHEN top > 1024 THEN 'volume_anomaly' WHEN iat_std > 1.0 OR iat_max > 10 THEN 'timing_anomaly' ELSE 'unknown' END
  FROM others JOIN timing USING ({GROUP_SQL}))
"""


@query(ALL_TYPED_SQL + "SELECT * RENAME (kind AS rule_type) FROM typed")
def rule_type_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule table on the windows of all protocols."""
    return comparable(feature_rows(spark, sf_dir).select(*WINDOW, cl.rule_type().alias("rule_type")))


@query(ALL_TYPED_SQL + """
SELECT kind, CASE kind WHEN 'command_injection' THEN 'T0831 - Manipulation of Control'
    WHEN 'protocol_violation' THEN 'T0855 - Unauthorized Command Message'
    WHEN 'unauthorized_access' THEN 'T0821 - Modify Controller Tasking'
    WHEN 'data_exfiltration' THEN 'T0882 - Theft of Operational Information'
    WHEN 'reconnaissance' THEN 'T0846 - Remote System Discovery'
    WHEN 'timing_anomaly' THEN 'T0882 - Theft of Operational Information' END AS technique, count(*) AS n
FROM typed GROUP BY ALL""")
def rule_technique_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As rule_technique, over the windows of all protocols."""
    rows = feature_rows(spark, sf_dir).select(cl.rule_type().alias("kind"))
    return comparable(
        rows.groupBy("kind", cl.mitre_technique(F.col("kind")).alias("technique")).agg(F.count(F.lit(1)).alias("n"))
    )


@query(f"""
WITH {ANOMALIES_SQL}
SELECT anomaly_id,
  CASE anomaly_type WHEN 'reconnaissance' THEN 'high' WHEN 'timing_anomaly' THEN 'medium'
    WHEN 'volume_anomaly' THEN 'medium' WHEN 'unknown' THEN 'medium' END AS severity,
  CASE anomaly_type WHEN 'reconnaissance' THEN 'T0846 - Remote System Discovery'
    WHEN 'timing_anomaly' THEN 'T0882 - Theft of Operational Information' END AS technique
FROM anomalies""")
def severity_and_technique(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("anomaly_type")
    return anomalies(spark, sf_dir).select(
        "anomaly_id", cl.type_severity(kind).alias("severity"), cl.mitre_technique(kind).alias("technique")
    )


@query(f"""
WITH {CORE_SQL},
fitted AS (SELECT avg(n) AS nm, stddev_pop(n) AS ns, avg(bm) AS mm, stddev_pop(bm) AS ms,
                  avg(iat_mean) AS im, stddev_pop(iat_mean) AS iss FROM scored)
SELECT {KEY_SQL}, round(least(1, abs(n - nm) / ns / 3), 3) AS message_count,
       round(least(1, abs(bm - mm) / ms / 3), 3) AS bytes_mean,
       round(least(1, abs(iat_mean - im) / iss / 3), 3) AS iat_mean
FROM scored CROSS JOIN fitted""")
def feature_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each of three features lies from its mean, in thirds of a deviation, at most 1."""
    from tidegauge.operators.prep import fit_scaler

    rows = feature_rows(spark, sf_dir)
    names = ["message_count", "bytes_mean", "iat_mean"]
    parts = cl.feature_contributions(fit_scaler(rows, names).stats())
    explained = rows.select(*WINDOW, parts.alias("m"))
    return comparable(explained.select(*WINDOW, *[F.col("m")[n].alias(n) for n in names]))


@query(f"""
WITH {CORRELATED_SQL},
assets AS (SELECT '10.0.1.' || (r_regionkey % 3) AS dst_ip, max(r_regionkey + 1) AS importance
           FROM region GROUP BY 1),
prior AS (
  SELECT *, count(*) OVER (PARTITION BY dst_ip ORDER BY detected_s
    RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS prior_alerts FROM correlated),
risky AS (
  SELECT alert_id, 0.4 * ensemble_score + 0.3 * coalesce(importance, 1) / 5
    + 0.2 * CASE WHEN anomaly_type = 'reconnaissance' THEN 0.75 ELSE 0.5 END
    + 0.1 * least(prior_alerts / 100, 1) AS risk
  FROM prior LEFT JOIN assets USING (dst_ip))
SELECT alert_id, round(risk, 3) AS risk, CASE WHEN risk > 0.9 THEN 'critical' WHEN risk >= 0.7 THEN 'high'
         WHEN risk >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level
FROM risky""")
def risk_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted risk; the importance of an asset is read from the `region` table."""
    from catalog.alerting import alerts
    from tidegauge.operators.lifecycle import prior_alert_context

    assets = (
        table(spark, sf_dir, "region")
        .groupBy(F.concat(F.lit("10.0.1."), F.col("r_regionkey") % 3).alias("ip"))
        .agg(F.max(F.col("r_regionkey") + 1).alias("importance"))
    )
    known = prior_alert_context(alerts(spark, sf_dir), 86400)
    rows = cl.risk_severity(known, assets, repeat_limit=100)
    return comparable(rows.select("alert_id", "risk", "risk_level"))


@query(f"""
WITH {ANOMALIES_SQL},
limits AS (
  SELECT src_ip, detected_s // 3600 % 24 AS hour, quantile_cont(ensemble_score, 0.95) AS threshold,
         count(*) AS samples FROM anomalies GROUP BY 1, 2)
SELECT src_ip, CAST(hour AS BIGINT) AS hour, round(threshold * 100, 3) AS threshold, samples,
       CAST((SELECT count(*) FROM anomalies a WHERE a.src_ip = limits.src_ip
             AND a.detected_s // 3600 % 24 = limits.hour AND a.ensemble_score > threshold + 1e-9) AS BIGINT)
         AS over
FROM limits""")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold per device and hour of day, and how many scores pass it."""
    scores = anomalies(spark, sf_dir)
    limits = cl.adaptive_threshold(scores)
    applied = cl.apply_adaptive_threshold(scores, limits.withColumn("threshold", F.col("threshold") + 1e-9))
    passed = applied.groupBy("src_ip", "hour").agg(F.count_if("over_threshold").alias("over"))
    joined = limits.join(passed, ["src_ip", "hour"])
    return comparable(joined.withColumn("threshold", F.col("threshold") * 100))

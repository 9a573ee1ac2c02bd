"""Reports over alerts, incidents and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.alerting import alerts, correlated, handled, incidents, status_updates
from catalog.registry import query
from catalog.views import ANOMALIES_SQL, CORRELATED_SQL, PRIORITY_SQL, anomalies, comparable, table
from tidegauge.operators import correlate as co
from tidegauge.operators import escalate, lifecycle, reports

PRIORITIES_SQL = PRIORITY_SQL + """,
final AS (SELECT incident_id, any_value(src_ip) AS src_ip, any_value(dst_ip) AS dst_ip,
                 'P' || min(rank) AS priority FROM ranked GROUP BY incident_id)
"""


@query(f"""
WITH RECURSIVE {PRIORITIES_SQL},
per AS (
  SELECT 'source' AS role, src_ip AS ip, count(*) AS incident_count, min(priority) AS max_priority
  FROM final GROUP BY src_ip
  UNION ALL
  SELECT 'destination', dst_ip, count(*), min(priority) FROM final GROUP BY dst_ip),
placed AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY incident_count DESC, ip) AS n FROM per)
SELECT role, ip, incident_count, max_priority FROM placed WHERE n <= 20""")
def host_incident_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = handled(spark, sf_dir)
    members = co.incident_members(correlated(spark, sf_dir))
    return comparable(reports.host_incident_summary(escalate.incident_priority(found), members=members))


@query(f"""
WITH RECURSIVE {PRIORITY_SQL},
moves AS (
  SELECT rank, coalesce(lag(rank) OVER (PARTITION BY incident_id ORDER BY detected_s, anomaly_id), 4) AS old
  FROM ranked)
SELECT CAST(count_if(NOT suppressed) AS BIGINT) AS alerts_processed,
       CAST(count_if(suppressed) AS BIGINT) AS dedup_suppressed,
       CAST(count_if(incident_seq = 1) AS BIGINT) AS incidents_created,
       CAST(count_if(incident_seq > 1) AS BIGINT) AS incidents_updated,
       (SELECT count(*) FROM moves WHERE rank <> old) AS escalations
FROM ranked""")
def pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = handled(spark, sf_dir)
    return comparable(reports.pipeline_counters(found, escalate.escalation_events(found)))


@query(f"""
WITH {CORRELATED_SQL}
SELECT (SELECT count(*) FROM correlated WHERE severity <> 'medium' AND anomaly_id % 2 <> 0) AS open_alerts,
       (SELECT count(DISTINCT incident_id) FROM correlated) AS active_incidents""")
def open_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    updated, _ = lifecycle.apply_status(alerts(spark, sf_dir), status_updates(spark, sf_dir), "alert_id")
    return comparable(reports.open_counts(updated, incidents(spark, sf_dir)))


@query(f"""
WITH {ANOMALIES_SQL}
SELECT CAST(detected_s - detected_s % 86400 AS BIGINT) AS period_start, protocol AS dimension,
       count(*) AS n, round(count(*) / 86400.0, 3) AS rate
FROM anomalies GROUP BY 1, 2""")
def rate_by_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(reports.rate_by(anomalies(spark, sf_dir), "protocol", 86400))


@query(f"""
WITH {ANOMALIES_SQL}
SELECT CAST(detected_s - detected_s % 3600 AS BIGINT) AS period_start, count(*) AS anomalies,
       CAST(count_if(classification <> 'normal') AS BIGINT) AS alerts,
       round(count_if(classification <> 'normal') / count(*), 3) AS ratio
FROM anomalies GROUP BY 1""")
def alert_to_anomaly_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(
        reports.alert_to_anomaly_ratio(alerts(spark, sf_dir), anomalies(spark, sf_dir), 3600)
    )


@query(f"""
WITH {ANOMALIES_SQL}
SELECT round(greatest(ceil(round(ensemble_score * 10, 9)), 1) / 10, 3) AS upper_bound, count(*) AS n
FROM anomalies GROUP BY 1""")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(reports.score_distribution(anomalies(spark, sf_dir)))


@query(f"""
WITH {ANOMALIES_SQL}
SELECT round(quantile_cont(ensemble_score, 0.95), 3) AS p95,
       round(quantile_cont(ensemble_score, 0.99), 3) AS p99
FROM anomalies""")
def score_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(reports.score_percentiles(anomalies(spark, sf_dir)))


@query("""
SELECT round(quantile_cont(s, 0.95), 7) AS p95, round(quantile_cont(s, 0.99), 7) AS p99
FROM (SELECT 0.99 + 0.001 * l_extendedprice / (l_extendedprice + 40000) AS s FROM lineitem)""")
def fine_score_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of scores that lie close together."""
    price = F.col("l_extendedprice")
    scores = table(spark, sf_dir, "lineitem").select((0.99 + 0.001 * price / (price + 40000)).alias("score"))
    found = reports.score_percentiles(scores, "score")
    return found.select(F.round("p95", 7).alias("p95"), F.round("p99", 7).alias("p99"))


@query(f"""
WITH {ANOMALIES_SQL}
SELECT src_ip || ':' || dst_ip AS pair, count(*) AS n FROM anomalies GROUP BY 1 ORDER BY n DESC, pair LIMIT 10""")
def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(reports.top_pairs(anomalies(spark, sf_dir)))


@query(f"""
WITH {CORRELATED_SQL}
SELECT coalesce(kind, 'all') AS kind, coalesce(severity, 'all') AS severity, count(*) AS n
FROM (SELECT coalesce(anomaly_type, 'unknown') AS kind, severity FROM correlated)
GROUP BY ROLLUP (kind, severity)""")
def by_type_and_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(reports.by_type_and_severity(alerts(spark, sf_dir)))



"""Records for receiving systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.alerting import LISTED_SQL, TITLE_SQL, alerts, handled, incidents
from catalog.registry import query
from catalog.views import CORRELATED_SQL, PRIORITY_SQL, WINDOWED_SQL, comparable, messages
from tidegauge.operators import escalate
from tidegauge.sources import export, topics

CEF_SQL = f"""
  'CEF:0|Telemetry|Alerting|1.0|ICS-' || upper(severity) || '|' || {TITLE_SQL} || '|'
  || CASE severity WHEN 'critical' THEN 10 WHEN 'medium' THEN 5 ELSE 3 END || '|src=' || src_ip
  || ' dst=' || dst_ip || ' proto=' || protocol || ' cs1=' || alert_id || ' cs1Label=AlertID cs2='
  || incident_id || ' cs2Label=IncidentID cs3=' || coalesce(anomaly_type, 'unknown')
  || ' cs3Label=AnomalyType cfp1=' || printf('%.3f', ensemble_score) || ' cfp1Label=EnsembleScore cfp2='
  || printf('%.3f', confidence) || ' cfp2Label=Confidence msg=' || {TITLE_SQL}"""


@query(f"""
WITH {CORRELATED_SQL}
SELECT alert_id, {CEF_SQL} AS cef,
       '<' || (128 + CASE severity WHEN 'critical' THEN 2 WHEN 'medium' THEN 4 ELSE 5 END) || '>'
       || strftime(to_timestamp(detected_s) AT TIME ZONE 'UTC', '%b %d %H:%M:%S')
       || ' ics-alerting ics-alerting: ' || {CEF_SQL} AS syslog
FROM correlated""")
def format_cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.format_cef(alerts(spark, sf_dir))


def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = escalate.escalation_events(handled(spark, sf_dir))
    return moved.join(incidents(spark, sf_dir), "incident_id")


ESCALATED_SQL = PRIORITY_SQL + "," + LISTED_SQL[len(CORRELATED_SQL) + 1:] + """,
moves AS (
  SELECT incident_id, detected_s, rank, coalesce(lag(rank) OVER (
           PARTITION BY incident_id ORDER BY detected_s, anomaly_id), 4) AS old FROM ranked),
escalated AS (
  SELECT m.incident_id, m.detected_s, 'P' || old AS old_p, 'P' || rank AS new_p, rank, n, best,
         array_to_string(src_ips, ',') AS src_ips, array_to_string(dst_ips, ',') AS dst_ips, title
  FROM moves m JOIN rolled USING (incident_id) WHERE old <> rank)
"""


@query(f"""
WITH RECURSIVE {ESCALATED_SQL}
SELECT incident_id, CAST(detected_s AS BIGINT) AS detected_s,
  'CEF:0|Telemetry|Alerting|1.0|ICS-ESCALATION|Priority Escalation: ' || old_p || ' -> ' || new_p || '|'
  || CASE rank WHEN 1 THEN 10 WHEN 2 THEN 7 WHEN 3 THEN 5 ELSE 3 END
  || '|cs1=' || incident_id || ' cs1Label=IncidentID cs2=' || old_p || ' cs2Label=OldPriority cs3=' || new_p
  || ' cs3Label=NewPriority cn1=' || n || ' cn1Label=AnomalyCount src=' || src_ips || ' dst=' || dst_ips
  || ' msg=Incident escalated from ' || old_p || ' to ' || new_p AS cef
FROM escalated""")
def format_cef_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.format_cef_escalation(escalations(spark, sf_dir)).drop("syslog")


def _payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return escalate.escalate(handled(spark, sf_dir)).withColumn("incident_status", F.lit("active"))


@query(f"""
WITH RECURSIVE {PRIORITY_SQL}
SELECT alert_id, 'alert' AS kind, severity, {TITLE_SQL} AS title, incident_id AS incident,
       'P' || rank AS priority, incident_seq AS anomaly_count,
       'ICS Alert: ' || {TITLE_SQL} AS chat_header,
       CASE severity WHEN 'critical' THEN '#ff0000' WHEN 'medium' THEN '#f2c744' ELSE '#36a64f' END AS color,
       round(ensemble_score, 3) AS hec_score
FROM ranked""")
def alert_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back out of the JSON bodies."""
    bodies = export.alert_payload(_payload_rows(spark, sf_dir))
    webhook = lambda path: F.get_json_object("webhook", path)
    return comparable(bodies.select(
        "alert_id",
        webhook("$.type").alias("kind"),
        webhook("$.alert.severity").alias("severity"),
        webhook("$.alert.title").alias("title"),
        webhook("$.incident.id").alias("incident"),
        webhook("$.incident.priority").alias("priority"),
        webhook("$.incident.anomaly_count").cast("bigint").alias("anomaly_count"),
        F.get_json_object("chat", "$.attachments[0].blocks[0].text.text").alias("chat_header"),
        F.get_json_object("chat", "$.attachments[0].color").alias("color"),
        F.get_json_object("hec", "$.event.ensemble_score").cast("double").alias("hec_score"),
    ))


@query(f"""
WITH RECURSIVE {ESCALATED_SQL}
SELECT incident_id, CAST(detected_s AS BIGINT) AS detected_s, 'escalation' AS kind, old_p AS old_priority,
       new_p AS new_priority, n AS anomaly_count, 'Incident Escalated: ' || title AS chat_header,
       src_ips AS hec_source
FROM escalated""")
def escalation_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = export.escalation_payload(escalations(spark, sf_dir))
    webhook = lambda path: F.get_json_object("webhook", path)
    return comparable(bodies.select(
        "incident_id", "detected_s",
        webhook("$.type").alias("kind"),
        webhook("$.old_priority").alias("old_priority"),
        webhook("$.incident.priority").alias("new_priority"),
        webhook("$.incident.anomaly_count").cast("bigint").alias("anomaly_count"),
        F.get_json_object("chat", "$.attachments[0].blocks[0].text.text").alias("chat_header"),
        F.get_json_object("hec", "$.event.src_ips[0]").alias("hec_source"),
    ))


@query(f"""
WITH {WINDOWED_SQL}
SELECT msg_id, src_ip || ':' || dst_ip || ':' || protocol AS key, 'ics.parsed.' || protocol AS topic,
       payload_size FROM messages""")
def keyed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as keyed JSON, each routed to the topic of its protocol."""
    records = topics.keyed(messages(spark, sf_dir), topics.message_topic())
    value = lambda path: F.get_json_object("value", path).cast("bigint")
    return records.select(
        value("$.msg_id").alias("msg_id"), "key", "topic", value("$.payload_size").alias("payload_size")
    )



"""Alerts and escalations in the formats of the receiving systems (delivery is not part of it)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.text import cef_extension, lookup, three_decimals

# ---- fixed values: severity scales ----------------------------------------------------------
CEF_SEVERITY = {"critical": 10, "high": 7, "medium": 5, "low": 3}
CEF_PRIORITY = {"P1": 10, "P2": 7, "P3": 5, "P4": 3}
SYSLOG_SEVERITY = {"critical": 2, "high": 3, "medium": 4, "low": 5}
SYSLOG_PRIORITY = {"P1": 2, "P2": 3, "P3": 4, "P4": 5}
SYSLOG_INFO = 6
SYSLOG_FACILITY = {
    "LOCAL0": 16, "LOCAL1": 17, "LOCAL2": 18, "LOCAL3": 19,
    "LOCAL4": 20, "LOCAL5": 21, "LOCAL6": 22, "LOCAL7": 23,
}
SEVERITY_COLOR = {"low": "#36a64f", "medium": "#f2c744", "high": "#ff9900", "critical": "#ff0000"}
PRIORITY_COLOR = {"P4": "#36a64f", "P3": "#f2c744", "P2": "#ff9900", "P1": "#ff0000"}
OTHER_COLOR = "#808080"


# the field names, labels and layout of the lines and bodies below are fixed formats


@dataclass(frozen=True)
class Sender:
    """How the sender names itself to the receiver."""

    vendor: str = "Telemetry"
    product: str = "Alerting"
    version: str = "1.0"
    prefix: str = "ICS"
    tag: str = "ics-alerting"
    host: str = "ics-alerting"
    facility: str = "LOCAL0"
    index: str = "main"
    sourcetype: str = "ics:alerts"
    channel: str = "#alerts"


def _cef(sender: Sender, signature: Column, name: Column, severity: Column, extension: Column) -> Column:
    return F.concat_ws(
        "|", F.lit("CEF:0"), F.lit(sender.vendor), F.lit(sender.product), F.lit(sender.version),
        signature, name, severity.cast("string"), extension,
    )


def _syslog(sender: Sender, severity: Column, sent_s: Column, cef: Column) -> Column:
    priority = SYSLOG_FACILITY[sender.facility.upper()] * 8 + severity
    stamp = F.date_format(F.timestamp_seconds(sent_s), "MMM dd HH:mm:ss")
    return F.concat(
        F.lit("<"), priority.cast("string"), F.lit(">"), stamp, F.lit(f" {sender.host} {sender.tag}: "), cef
    )


def format_cef(alerts: DataFrame, sender: Sender = Sender()) -> DataFrame:
    """`alert_id, cef, syslog` of alerts that carry their incident id."""
    text = lambda value: F.lit(value)
    extension = cef_extension([
        ("src", F.col("src_ip")),
        ("dst", F.col("dst_ip")),
        ("proto", F.col("protocol")),
        ("cs1", F.col("alert_id")), ("cs1Label", text("AlertID")),
        ("cs2", F.col("incident_id")), ("cs2Label", text("IncidentID")),
        ("cs3", F.coalesce("anomaly_type", F.lit("unknown"))), ("cs3Label", text("AnomalyType")),
        ("cfp1", three_decimals(F.col("ensemble_score"))), ("cfp1Label", text("EnsembleScore")),
        ("cfp2", three_decimals(F.col("confidence"))), ("cfp2Label", text("Confidence")),
        ("msg", F.col("title")),
    ])
    signature = F.concat(F.lit(f"{sender.prefix}-"), F.upper("severity"))
    severity = F.col("severity")
    cef = _cef(sender, signature, F.col("title"), lookup(CEF_SEVERITY, severity, F.lit(5)), extension)
    level = lookup(SYSLOG_SEVERITY, severity, F.lit(SYSLOG_INFO))
    return alerts.select(
        "alert_id", cef.alias("cef"), _syslog(sender, level, F.col("detected_s"), cef).alias("syslog")
    )


def format_cef_escalation(escalations: DataFrame, sender: Sender = Sender()) -> DataFrame:
    """`incident_id, detected_s, cef, syslog` of escalations joined with their incident.

    Needs `old_priority, new_priority, anomaly_count, src_ips, dst_ips`.
    """
    old, new = F.col("old_priority"), F.col("new_priority")
    text = lambda value: F.lit(value)
    extension = cef_extension([
        ("cs1", F.col("incident_id")), ("cs1Label", text("IncidentID")),
        ("cs2", old), ("cs2Label", text("OldPriority")),
        ("cs3", new), ("cs3Label", text("NewPriority")),
        ("cn1", F.col("anomaly_count")), ("cn1Label", text("AnomalyCount")),
        ("src", F.array_join("src_ips", ",")),
        ("dst", F.array_join("dst_ips", ",")),
        ("msg", F.concat(F.lit("Incident escalated from "), old, F.lit(" to "), new)),
    ])
    name = F.concat(F.lit("Priority Escalation: "), old, F.lit(" -> "), new)
    cef = _cef(
        sender, F.lit(f"{sender.prefix}-ESCALATION"), name, lookup(CEF_PRIORITY, new, F.lit(5)), extension
    )
    level = lookup(SYSLOG_PRIORITY, new, F.lit(SYSLOG_INFO))
    return escalations.select(
        "incident_id", "detected_s", cef.alias("cef"),
        _syslog(sender, level, F.col("detected_s"), cef).alias("syslog"),
    )


def _alert_struct() -> Column:
    return F.struct(
        F.col("alert_id").alias("id"), "incident_id",
        F.timestamp_seconds("detected_s").alias("created_at"), "severity", "status", "title",
        "description",
        F.struct("src_ip", "dst_ip", "protocol", "window_size", "window_start").alias("source"),
        "anomaly_type", "ensemble_score", "confidence",
        F.lit(1).alias("related_anomaly_count"), "feature_contributions",
    )


def _mrkdwn(label: str, value: Column) -> Column:
    return F.struct(
        F.lit("mrkdwn").alias("type"), F.concat(F.lit(f"*{label}:*\n"), value).alias("text")
    )


def _fields(pairs: list[tuple[str, Column]]) -> Column:
    return F.array(*[_mrkdwn(label, value) for label, value in pairs])


def _header(prefix: str, title: Column) -> Column:
    text = F.struct(F.lit("plain_text").alias("type"), F.concat(F.lit(prefix), title).alias("text"))
    return F.struct(F.lit("header").alias("type"), text.alias("text"))


def _context(text: Column) -> Column:
    element = F.struct(F.lit("mrkdwn").alias("type"), text.alias("text"))
    return F.struct(F.lit("context").alias("type"), F.array(element).alias("elements"))


def _hec(sender: Sender, event: Column) -> Column:
    return F.to_json(F.struct(
        F.col("detected_s").cast("double").alias("time"),
        F.lit(sender.host).alias("host"),
        F.lit(sender.tag).alias("source"),
        F.lit(sender.sourcetype).alias("sourcetype"),
        F.lit(sender.index).alias("index"),
        event.alias("event"),
    ), {"ignoreNullFields": "false"})


def _chat(sender: Sender, color: Column, blocks: list[Column]) -> Column:
    """Blocks have different shapes, so each becomes JSON on its own."""
    listed = F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(b) for b in blocks]), F.lit("]"))
    return F.concat(
        F.lit('{"channel":"' + sender.channel + '","attachments":[{"color":"'), color,
        F.lit('","blocks":'), listed, F.lit("}]}"),
    )


def alert_payload(alerts: DataFrame, sender: Sender = Sender()) -> DataFrame:
    """`alert_id, webhook, hec, chat`: JSON bodies of an alert.

    Needs the alert columns plus `priority`, `incident_seq` (anomalies so far) and
    `incident_status`.
    """
    incident = F.struct(
        F.col("incident_id").alias("id"), "priority", F.col("incident_seq").alias("anomaly_count"),
        F.col("incident_status").alias("status"),
    )
    webhook = F.to_json(
        F.struct(F.lit("alert").alias("type"), _alert_struct().alias("alert"), incident.alias("incident")),
        {"ignoreNullFields": "false"},
    )
    event = F.struct(
        F.lit("ics_alert").alias("event_type"), "alert_id", "incident_id", "severity", "status", "title",
        "description", "src_ip", "dst_ip", "protocol", "anomaly_type", "ensemble_score", "confidence",
        F.col("priority").alias("incident_priority"),
        F.col("incident_seq").alias("incident_anomaly_count"),
    )
    section = F.struct(
        F.lit("section").alias("type"),
        _fields([
            ("Severity", F.upper("severity")),
            ("Score", three_decimals(F.col("ensemble_score"))),
            ("Source", F.col("src_ip")),
            ("Destination", F.col("dst_ip")),
            ("Protocol", F.upper("protocol")),
            ("Type", F.coalesce("anomaly_type", F.lit("Unknown"))),
        ]).alias("fields"),
    )
    footer = F.concat(
        F.lit("Incident: "), F.substring("incident_id", 1, 8), F.lit("... | Priority: "),
        F.col("priority"), F.lit(" | Anomalies: "), F.col("incident_seq").cast("string"),
    )
    color = lookup(SEVERITY_COLOR, F.col("severity"), F.lit(OTHER_COLOR))
    blocks = [_header(f"{sender.prefix} Alert: ", F.col("title")), section, _context(footer)]
    return alerts.select(
        "alert_id", webhook.alias("webhook"), _hec(sender, event).alias("hec"),
        _chat(sender, color, blocks).alias("chat"),
    )


def escalation_payload(escalations: DataFrame, sender: Sender = Sender()) -> DataFrame:
    """`incident_id, detected_s, webhook, hec, chat`: JSON bodies of an escalation.

    Needs escalations joined with their incident row. Alert ids stay in the alert table, where
    `incident_id` finds them; an incident can have any number of them.
    """
    old, new = F.col("old_priority"), F.col("new_priority")
    incident = F.struct(
        F.col("incident_id").alias("id"), "correlation_key",
        F.timestamp_seconds("created_s").alias("created_at"),
        F.timestamp_seconds("updated_s").alias("updated_at"),
        "status", new.alias("priority"), "anomaly_count", "max_ensemble_score",
        "src_ips", "dst_ips", "anomaly_types", "title", "description",
    )
    webhook = F.to_json(F.struct(
        F.lit("escalation").alias("type"), incident.alias("incident"), old.alias("old_priority"),
        new.alias("new_priority"),
    ))
    event = F.struct(
        F.lit("ics_escalation").alias("event_type"), "incident_id", "old_priority", "new_priority",
        "anomaly_count", "src_ips", "dst_ips", "anomaly_types", "title", "description",
    )
    section = F.struct(
        F.lit("section").alias("type"),
        _fields([
            ("Priority Change", F.concat(old, F.lit(" → "), new)),
            ("Anomaly Count", F.col("anomaly_count").cast("string")),
            ("Max Score", three_decimals(F.col("max_ensemble_score"))),
            ("Sources", F.array_join(F.slice("src_ips", 1, 3), ", ")),
        ]).alias("fields"),
    )
    targets = F.struct(
        F.lit("mrkdwn").alias("type"),
        F.concat(F.lit("*Targets:* "), F.array_join(F.slice("dst_ips", 1, 5), ", ")).alias("text"),
    )
    blocks = [
        _header("Incident Escalated: ", F.col("title")), section,
        F.struct(F.lit("section").alias("type"), targets.alias("text")),
        _context(F.concat(F.lit("Incident ID: "), F.col("incident_id"))),
    ]
    color = lookup(PRIORITY_COLOR, new, F.lit(OTHER_COLOR))
    return escalations.select(
        "incident_id", "detected_s", webhook.alias("webhook"), _hec(sender, event).alias("hec"),
        _chat(sender, color, blocks).alias("chat"),
    )

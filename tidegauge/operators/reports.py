"""Reads for dashboards: host summaries, counters, rates, distributions, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.ordered import exact_quantiles
from tidegauge.functions.stats import one_row
from tidegauge.functions.text import joined_key


def host_incident_summary(incidents: DataFrame, top: int = 20, members: DataFrame | None = None) -> DataFrame:
    """Per role and address: number of incidents and best priority; the first `top` of a role.

    `members` (`correlate.incident_members`) has every address of an incident; without it the lists in the incidents count,
    which hold the first ones only. One pass over either; a task keeps its first `top` of a role before the shuffle.
    """
    roles = {"src_ips": "source", "dst_ips": "destination"}
    if members is None:
        named = lambda column, role: F.transform(column, lambda ip: F.struct(F.lit(role).alias("role"), ip.alias("ip")))
        each = incidents.select(F.explode(F.concat(*[named(c, r) for c, r in roles.items()])).alias("e"), "priority")
        each = each.select("e.role", "e.ip", "priority")
    else:
        role = F.when(F.col("kind") == "src_ips", "source").otherwise("destination")
        hosts = members.filter(F.col("kind").isin(*roles)).select("incident_id", role.alias("role"), F.col("value").alias("ip"))
        each = hosts.join(incidents.select("incident_id", "priority"), "incident_id").select("role", "ip", "priority")
    per = each.groupBy("role", "ip").agg(
        F.count(F.lit(1)).alias("incident_count"), F.min("priority").alias("max_priority")
    )
    place = Window.partitionBy("role").orderBy(F.desc("incident_count"), "ip")
    ranked = per.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= top)
    return ranked.select("ip", "incident_count", "max_priority", "role")


def pipeline_counters(alerts: DataFrame, escalations: DataFrame) -> DataFrame:
    """Processed, suppressed, created, updated and escalated, in one row."""
    counts = alerts.agg(
        F.count_if(~F.col("suppressed")).alias("alerts_processed"),
        F.count_if("suppressed").alias("dedup_suppressed"),
        F.count_if(F.col("incident_seq") == 1).alias("incidents_created"),
        F.count_if(F.col("incident_seq") > 1).alias("incidents_updated"),
    )
    raised = escalations.agg(F.count(F.lit(1)).alias("escalations"))
    return one_row(counts, raised)


def open_counts(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    opened = alerts.agg(F.count_if(F.col("status") == "open").alias("open_alerts"))
    active = incidents.agg(F.count_if(F.col("status") == "active").alias("active_incidents"))
    return one_row(opened, active)


def rate_by(df: DataFrame, dimension: str, period_s: int, time: str = "detected_s") -> DataFrame:
    """Rows per second of each value of a dimension, per period."""
    start = F.col(time) - F.pmod(F.col(time), F.lit(period_s))
    return (
        df.groupBy(start.alias("period_start"), F.col(dimension).alias("dimension"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("rate", F.col("n") / period_s)
    )


def alert_to_anomaly_ratio(
    alerts: DataFrame, anomalies: DataFrame, period_s: int, time: str = "detected_s"
) -> DataFrame:
    """Alerts per anomaly, per period that has anomalies."""
    start = (F.col(time) - F.pmod(F.col(time), F.lit(period_s))).alias("period_start")
    of = lambda df, name: df.groupBy(start).agg(F.count(F.lit(1)).alias(name))
    joined = of(anomalies, "anomalies").join(of(alerts, "alerts"), "period_start", "left")
    alerts_n = F.coalesce("alerts", F.lit(0))
    return joined.select("period_start", "anomalies", alerts_n.alias("alerts"),
                         (alerts_n / F.col("anomalies")).alias("ratio"))


# fixed value: upper bounds of the score histogram are the ten tenths
SCORE_BUCKETS = 10


def score_distribution(df: DataFrame, score: str = "ensemble_score") -> DataFrame:
    """Rows per tenth of the score, each bucket including its upper bound."""
    bucket = F.greatest(F.ceil(F.round(F.col(score) * SCORE_BUCKETS, 9)), F.lit(1))
    return (
        df.groupBy((bucket / SCORE_BUCKETS).alias("upper_bound"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def score_percentiles(df: DataFrame, score: str = "ensemble_score") -> DataFrame:
    """p95 and p99 of the scores as they are; both are NULL without scores."""
    return exact_quantiles(df, score, {"p95": 0.95, "p99": 0.99}).agg(F.max("p95").alias("p95"), F.max("p99").alias("p99"))


def top_pairs(df: DataFrame, top: int = 10) -> DataFrame:
    """Busiest source and destination pairs."""
    return (
        df.groupBy(joined_key("src_ip", "dst_ip").alias("pair"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "pair")
        .limit(top)
    )


def by_type_and_severity(alerts: DataFrame) -> DataFrame:
    """Alerts per type and severity, with totals per type and over all."""
    kind = F.coalesce("anomaly_type", F.lit("unknown")).alias("kind")
    return (
        alerts.select(kind, "severity")
        .rollup("kind", "severity")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.coalesce("kind", F.lit("all")).alias("kind"),
            F.coalesce("severity", F.lit("all")).alias("severity"),
            "n",
        )
    )

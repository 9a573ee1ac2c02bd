"""Incident priority: rules, running priority and the changes of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Escalation:
    """Thresholds of the rules (fixed values by default)."""

    p3: int = 5
    p2: int = 10
    p1: int = 20
    critical_severity: bool = True
    multi_target: bool = True
    targets: int = 3


def count_rank(count: Column, rules: Escalation) -> Column:
    return (
        F.when(count >= rules.p1, 1).when(count >= rules.p2, 2).when(count >= rules.p3, 3).otherwise(4)
    )


def incident_rank(count: Column, severity: Column, targets: Column, rules: Escalation) -> Column:
    """Rank 1..4 the rules ask for at one alert."""
    ranks = [count_rank(count, rules)]
    if rules.critical_severity:
        ranks.append(F.when(severity == "critical", 2).otherwise(4))
    if rules.multi_target:
        ranks.append(F.when(targets >= rules.targets, 2).otherwise(4))
    return F.least(*ranks) if len(ranks) > 1 else ranks[0]


def priority_name(rank: Column) -> Column:
    return F.concat(F.lit("P"), rank.cast("string"))


def _at() -> Column:
    return F.struct("detected_s", "anomaly_id")


def _many_targets(alerts: DataFrame, rules: Escalation) -> DataFrame:
    """Per incident, the alert at which the number of distinct targets reaches the rule."""
    firsts = alerts.groupBy("incident_id", "dst_ip").agg(F.min(_at()).alias("targets_at"))
    order = Window.partitionBy("incident_id").orderBy("targets_at")
    return (
        firsts.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= rules.targets)  # limits every task before the shuffle
        .filter(F.col("n") == rules.targets)
        .select("incident_id", "targets_at")
    )


def rank_levels(alerts: DataFrame, rules: Escalation = Escalation()) -> DataFrame:
    """Per incident, the first unsuppressed alert at which each priority is reached.

    A priority never goes down, so the running minimum over an incident is fully described by
    three moments, and those are plain minimum aggregates. Suppressed alerts count towards the
    thresholds but do not trigger a rule.
    """
    if rules.multi_target:
        alerts = alerts.join(_many_targets(alerts, rules), "incident_id", "left")
        targets = F.when(_at() >= F.col("targets_at"), rules.targets).otherwise(0)
    else:
        targets = F.lit(0)
    rank = incident_rank(F.col("incident_seq"), F.col("severity"), targets, rules)
    return (
        alerts.filter(~F.col("suppressed"))
        .withColumn("rank", rank)
        .groupBy("incident_id")
        .agg(*[F.min(F.when(F.col("rank") <= r, _at())).alias(f"p{r}_at") for r in (3, 2, 1)])
    )


def _rank_at(moment: Column) -> Column:
    return (
        F.when(moment >= F.col("p1_at"), 1)
        .when(moment >= F.col("p2_at"), 2)
        .when(moment >= F.col("p3_at"), 3)
        .otherwise(4)
    )


def escalate(alerts: DataFrame, rules: Escalation = Escalation()) -> DataFrame:
    """Alerts with the priority their incident has once they are handled."""
    levels = rank_levels(alerts, rules)
    joined = alerts.join(levels, "incident_id", "left")
    return joined.withColumn("priority", priority_name(_rank_at(_at()))).drop("p1_at", "p2_at", "p3_at")


def incident_priority(alerts: DataFrame, rules: Escalation = Escalation()) -> DataFrame:
    """`incident_id, priority` after all alerts."""
    levels = rank_levels(alerts, rules)
    rank = (
        F.when(F.col("p1_at").isNotNull(), 1)
        .when(F.col("p2_at").isNotNull(), 2)
        .when(F.col("p3_at").isNotNull(), 3)
        .otherwise(4)
    )
    return levels.select("incident_id", priority_name(rank).alias("priority"))


def escalation_events(alerts: DataFrame, rules: Escalation = Escalation()) -> DataFrame:
    """One row per change of priority: when, by which anomaly, from what to what."""
    levels = rank_levels(alerts, rules)
    step = lambda rank: F.when(
        F.col(f"p{rank}_at").isNotNull(),
        F.struct(F.col(f"p{rank}_at").alias("at"), F.lit(rank).alias("rank")),
    )
    moments = F.array_compact(F.array(*[step(r) for r in (3, 2, 1)]))
    changes = (
        levels.select("incident_id", F.explode(moments).alias("m"))
        .groupBy("incident_id", F.col("m.at").alias("at"))
        .agg(F.min("m.rank").alias("rank"))
    )
    order = Window.partitionBy("incident_id").orderBy("at")
    before = F.coalesce(F.lag("rank").over(order), F.lit(4))
    return changes.select(
        "incident_id",
        F.col("at.detected_s").alias("detected_s"),
        F.col("at.anomaly_id").alias("anomaly_id"),
        priority_name(before).alias("old_priority"),
        priority_name(F.col("rank")).alias("new_priority"),
    )

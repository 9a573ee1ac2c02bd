"""Anomalies to alerts, and alerts grouped into incidents by gap sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.text import (
    capitalised,
    joined_key,
    three_decimals,
    title_case,
)
from tidegauge.operators.classify import top_contributors
from tidegauge.operators.windows import FLOW

GAP_S = 300

# fixed values: severity of an alert by classification
CLASS_SEVERITY = {
    "normal": "low",
    "suspicious": "low",
    "anomaly": "medium",
    "critical": "critical",
}


def drop_normal(anomalies: DataFrame) -> DataFrame:
    return anomalies.filter(F.lower("classification") != "normal")


def correlation_key(columns: Sequence[str] = FLOW) -> Column:
    return joined_key(*columns)


def dedup_key(columns: Sequence[str] = FLOW) -> Column:
    """The correlation key and the type; a missing type is spelled `None`."""
    return joined_key(*columns, F.coalesce("anomaly_type", F.lit("None")))


def correlate(
    anomalies: DataFrame,
    gap_s: int = GAP_S,
    key_columns: Sequence[str] = FLOW,
    closures: DataFrame | None = None,
    slice_s: int | None = None,
) -> DataFrame:
    """Each anomaly with its incident and its running number inside it.

    An anomaly joins the incident of its key when it comes at most `gap_s` after the last one.
    `closures(correlation_key, closed_s)` end the incident of a key: a later anomaly opens a new
    one.

    Anomalies of a key that share a time slice no longer than the gap belong together anyway,
    so the sessions are found on one summary row per key and slice, and every step over single
    anomalies is split by slice. A key that carries a large share of all rows therefore never
    meets in one task.
    """
    slice_s = min(slice_s or gap_s, gap_s)
    keyed = anomalies.withColumn("correlation_key", correlation_key(key_columns))
    keyed = _with_era(keyed, closures, slice_s)
    keyed = keyed.withColumn("slice", F.floor(F.col("detected_s") / slice_s))
    place = ["correlation_key", "era", "slice"]

    pieces = keyed.groupBy(*place).agg(
        F.min("detected_s").alias("first_s"),
        F.max("detected_s").alias("last_s"),
        F.count(F.lit(1)).alias("rows"),
    )
    along = Window.partitionBy("correlation_key").orderBy("era", "slice")
    opens = (
        F.lag("last_s").over(along).isNull()
        | (F.lag("era").over(along) != F.col("era"))
        | (F.col("first_s") - F.lag("last_s").over(along) > gap_s)
    )
    pieces = pieces.withColumn("opens", opens.cast("int"))
    pieces = pieces.withColumn("session", F.sum("opens").over(along))
    inside = Window.partitionBy("correlation_key", "session").orderBy("era", "slice")
    pieces = pieces.select(
        *place,
        F.first("first_s").over(inside).alias("incident_started_s"),
        F.coalesce(
            F.sum("rows").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    numbered = Window.partitionBy(*place).orderBy("detected_s", "anomaly_id")
    # incidents of a key share no second, so their start names them
    identity = F.concat_ws("|", "correlation_key", F.col("incident_started_s").cast("string"), F.lit("0"))
    return (
        keyed.join(pieces, place)
        .withColumn("incident_seq", F.col("before") + F.row_number().over(numbered))
        .withColumn("incident_id", F.substring(F.sha2(identity, 256), 1, 32))
        .drop("era", "slice", "before")
    )


def _with_era(keyed: DataFrame, closures: DataFrame | None, slice_s: int) -> DataFrame:
    """How many closures of the key lie before the anomaly: those of earlier slices and of its own."""
    if closures is None:
        return keyed.withColumn("era", F.lit(0))
    closing = closures.select(
        "correlation_key", F.col("closed_s").cast("bigint").alias("detected_s"), F.lit(1).alias("closing")
    )
    both = keyed.unionByName(closing, allowMissingColumns=True).withColumn(
        "era_slice", F.floor(F.col("detected_s") / slice_s)
    )
    place = ["correlation_key", "era_slice"]
    earlier = Window.partitionBy("correlation_key").orderBy("era_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = both.groupBy(*place).agg(F.count("closing").alias("closed")).select(
        *place, F.sum("closed").over(earlier).alias("closed_before")
    )
    inside = Window.partitionBy(*place).orderBy("detected_s").rangeBetween(Window.unboundedPreceding, -1)
    counted = both.withColumn("closed_inside", F.count("closing").over(inside)).filter("closing IS NULL")
    era = F.coalesce("closed_before", F.lit(0)) + F.col("closed_inside")
    return (
        counted.join(slices, place).withColumn("era", era)
        .drop("closing", "era_slice", "closed_inside", "closed_before")
    )


def incident_sessions(
    anomalies: DataFrame, gap_s: int = GAP_S, key_columns: Sequence[str] = FLOW
) -> DataFrame:
    """Incident bounds alone, with the built-in session window; also runs on a stream."""
    return (
        anomalies.withColumn("correlation_key", correlation_key(key_columns))
        .withColumn("ts", F.timestamp_seconds("detected_s"))
        .groupBy("correlation_key", F.session_window("ts", f"{gap_s} seconds").alias("session"))
        .agg(
            F.count(F.lit(1)).alias("anomaly_count"),
            F.max("ensemble_score").alias("max_ensemble_score"),
        )
        .select(
            "correlation_key",
            F.unix_seconds("session.start").alias("incident_started_s"),
            (F.unix_seconds("session.end") - gap_s).alias("last_s"),
            "anomaly_count",
            "max_ensemble_score",
        )
    )


LISTED = 100  # values of a kind an incident's own row lists
_KINDS = {"src_ips": "src_ip", "dst_ips": "dst_ip", "anomaly_types": "anomaly_type"}


def incident_members(correlated: DataFrame) -> DataFrame:
    """One row per incident, kind (`src_ips`, `dst_ips`, `anomaly_types`) and distinct value: first seen, number of alerts.

    Incidents may have any number of them, so this table of its own is where all are.
    """
    entries = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value")) for kind, column in _KINDS.items()
    ])
    return (
        correlated.select(
            "correlation_key", "incident_id", F.struct("detected_s", "anomaly_id").alias("at"), F.explode(entries).alias("entry")
        )
        .filter(F.col("entry.value").isNotNull() & (F.col("entry.value") != ""))
        .groupBy("correlation_key", "incident_id", F.col("entry.kind").alias("kind"), F.col("entry.value").alias("value"))
        .agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("alerts"))
        .select("correlation_key", "incident_id", "kind", "value", F.col("at.detected_s").alias("first_s"), "at", "alerts")
    )


def incident_rollup(correlated: DataFrame, list_alerts: bool = False, listed: int = LISTED) -> DataFrame:
    """One row per incident: counts, maximum score, addresses and types in first-seen order.

    The lists hold the first `listed` values, the counts beside them (`src_ips_count` ...) all; the rest is in
    `incident_members`. The ids of the alerts are the
    `incident_id` column of the alerts; `list_alerts` also writes them into an array, for
    incidents known to be small.
    """
    identity = ["correlation_key", "incident_id"]
    totals = correlated.groupBy(*identity).agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        F.max("ensemble_score").alias("max_ensemble_score"),
        F.min("detected_s").alias("created_s"),
        F.max("detected_s").alias("updated_s"),
        *(
            [
                F.transform(
                    F.array_sort(F.collect_list(F.struct("incident_seq", alert_id().alias("id")))),
                    lambda e: e["id"],
                ).alias("alert_ids")
            ]
            if list_alerts
            else []
        ),
    )
    members = incident_members(correlated)
    sizes = members.groupBy(*identity).agg(*[F.count_if(F.col("kind") == kind).alias(f"{kind}_count") for kind in _KINDS])
    in_order = Window.partitionBy(*identity, "kind").orderBy("at", "value")
    # Spark keeps the first ones of every task before it shuffles
    first = members.withColumn("place", F.row_number().over(in_order)).filter(F.col("place") <= listed)
    lists = first.groupBy(*identity).agg(*[
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "value")))),
            lambda e: e["value"],
        ).alias(kind)
        for kind in _KINDS
    ]).join(sizes, identity)
    rolled = totals.join(lists, identity)
    return (
        rolled.withColumn("status", F.lit("active"))
        .withColumn("multi_source", F.col("src_ips_count") > 1)
        .withColumn("multi_target", F.col("dst_ips_count") > 1)
        .withColumn("title", incident_title())
        .withColumn("description", incident_description())
    )


# the wording of titles and descriptions below is a fixed format
def incident_title() -> Column:
    kinds = F.col("anomaly_types_count")
    return (
        F.when(kinds == 1, F.concat(title_case(F.get("anomaly_types", F.lit(0))), F.lit(" Incident")))
        .when(
            kinds > 1,
            F.concat(
                F.lit("Multi-type Anomaly Incident ("), kinds.cast("string"), F.lit(" types)")
            ),
        )
        .otherwise("Anomaly Incident")
    )


def incident_description() -> Column:
    first_five = lambda name: F.array_join(F.slice(name, 1, 5), ", ")
    return F.concat(
        F.lit("Correlated incident with "), F.col("anomaly_count").cast("string"),
        F.lit(" anomalies. Sources: "), first_five("src_ips"),
        F.lit(". Targets: "), first_five("dst_ips"),
        F.lit(". Max score: "), three_decimals(F.col("max_ensemble_score")),
    )


def alert_id() -> Column:
    return F.substring(F.sha2(F.concat(F.lit("alert|"), F.col("anomaly_id").cast("string")), 256), 1, 32)


def alert_severity() -> Column:
    """By class; a score of 0.9 is critical, 0.7 lifts low to medium, an unknown class is medium."""
    base = F.lower("classification")
    mapped = None
    for name, severity in CLASS_SEVERITY.items():
        mapped = F.when(base == name, severity) if mapped is None else mapped.when(base == name, severity)
    mapped = mapped.otherwise("medium")
    score = F.col("ensemble_score")
    return (
        F.when(score >= 0.9, "critical")
        .when((score >= 0.7) & (mapped == "low"), "medium")
        .otherwise(mapped)
    )


def alert_title() -> Column:
    kind = F.coalesce(F.nullif(F.col("anomaly_type"), F.lit("")), F.lit("Unknown"))
    generic = F.concat(
        capitalised(F.col("classification")), F.lit(" "), F.upper("protocol"),
        F.lit(" traffic from "), F.col("src_ip"),
    )
    named = F.concat(title_case(kind), F.lit(" detected from "), F.col("src_ip"))
    return F.when(F.lower(kind) == "unknown", generic).otherwise(named)


def alert_description() -> Column:
    """Several lines; the type and the five strongest features only where they are known."""
    line = lambda label, value: F.concat(F.lit(f"  {label}: "), value)
    features = F.transform(
        top_contributors(F.col("feature_contributions"), 5),
        lambda e: F.concat(F.lit("    - "), e["key"], F.lit(": "), three_decimals(e["value"])),
    )
    has_features = F.size("feature_contributions") > 0
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Anomaly detected in "), F.upper("protocol"), F.lit(" traffic")),
        line("Source", F.col("src_ip")),
        line("Destination", F.col("dst_ip")),
        line("Classification", F.col("classification")),
        line("Ensemble Score", three_decimals(F.col("ensemble_score"))),
        line("Confidence", three_decimals(F.col("confidence"))),
        F.when(F.col("anomaly_type") != "", line("Type", F.col("anomaly_type"))),
        F.when(has_features, F.lit("  Top Features:")),
        F.when(has_features, F.array_join(features, "\n")),
    )


def to_alerts(correlated: DataFrame) -> DataFrame:
    """Alerts out of correlated anomalies: one projection."""
    return (
        correlated.withColumn("alert_id", alert_id())
        .withColumn("severity", alert_severity())
        .withColumn("status", F.lit("open"))
        .withColumn("title", alert_title())
        .withColumn("description", alert_description())
        .withColumn("dedup_key", dedup_key())
    )

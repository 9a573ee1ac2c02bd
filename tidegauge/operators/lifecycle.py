"""Status changes, listings and look-backs over alerts and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RELEASING = ("acknowledged", "resolved")  # fixed values: states of an alert that end its lock


def apply_status(
    table: DataFrame, updates: DataFrame, id_column: str, moves_updated: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The table with the latest status of every id, and the updates whose id is not in it.

    `updates(id, status, at_s)`; for incidents the update also moves `updated_s`.
    """
    latest = updates.groupBy(F.col("id").alias(id_column)).agg(
        F.max_by("status", F.struct("at_s", "status")).alias("new_status"),
        F.max("at_s").alias("status_at_s"),
    )
    joined = table.join(latest, id_column, "left").withColumn(
        "status", F.coalesce("new_status", "status")
    )
    if moves_updated:
        joined = joined.withColumn("updated_s", F.greatest("updated_s", "status_at_s"))
    missing = updates.join(
        table.select(F.col(id_column).alias("id")), "id", "left_anti"
    )
    return joined.drop("new_status", "status_at_s"), missing


def releases_of(updates: DataFrame, alerts: DataFrame) -> DataFrame:
    """`correlation_key, dedup_key, released_s`: alerts that were acknowledged or resolved free their key for new ones.

    `updates(id, status, at_s)` name alerts; unknown ids release nothing. Alerts meet their updates by id, so no key is hot.
    """
    freeing = updates.filter(F.col("status").isin(*RELEASING)).select(
        F.col("id").alias("alert_id"), F.col("at_s").cast("bigint").alias("released_s")
    )
    keys = alerts.select("alert_id", "correlation_key", "dedup_key")
    return freeing.join(keys, "alert_id").select("correlation_key", "dedup_key", "released_s").distinct()


def closures_of(updates: DataFrame, incidents: DataFrame) -> DataFrame:
    """`correlation_key, closed_s`: an incident that is no longer active takes no more alerts."""
    closing = updates.filter(F.col("status") != "active").select(
        F.col("id").alias("incident_id"), F.col("at_s").cast("bigint").alias("closed_s")
    )
    keys = incidents.select("incident_id", "correlation_key").distinct()
    return closing.join(keys, "incident_id").select("correlation_key", "closed_s").distinct()


def list_alerts(
    alerts: DataFrame, status: str | None = None, severity: str | None = None, limit: int = 50
) -> DataFrame:
    """Newest first; filters apply before the limit."""
    if status:
        alerts = alerts.filter(F.col("status") == status)
    if severity:
        alerts = alerts.filter(F.col("severity") == severity)
    return alerts.orderBy(F.desc("detected_s"), F.desc("anomaly_id")).limit(limit)


def list_incidents(incidents: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Most recently updated first, each incident once."""
    if status:
        incidents = incidents.filter(F.col("status") == status)
    return incidents.orderBy(F.desc("updated_s"), F.desc("incident_id")).limit(limit)


def get_by_id(table: DataFrame, id_column: str, value: str) -> DataFrame:
    return table.filter(F.col(id_column) == value)


def apply_retention(
    df: DataFrame, time: str, ttl_s: int, as_of_s: int, last: int | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Rows younger than the time to live, and of those the newest `last`."""
    kept = df.filter(F.col(time) >= as_of_s - ttl_s)
    if last is None:
        return kept
    order = [F.desc(time)] + ([F.desc(tie)] if tie else [])
    return kept.orderBy(*order).limit(last)


def prior_alert_context(
    alerts: DataFrame, lookback_s: int, asset: str = "dst_ip", slice_s: int | None = None
) -> DataFrame:
    """Alerts with the number and the best score of earlier alerts on the same asset.

    Counts whole seconds before the alert, back to `lookback_s`. Seconds of an asset are summed up first. Blocks of
    time are as long as the look-back, so what lies before a second is the beginning of its own block and the end of the
    one before: each a running sum inside a block, so the work grows with the seconds and not with pairs of them.
    `slice_s` changes neither results nor blocks; it is kept for callers that set it.
    """
    seconds = alerts.groupBy(asset, "detected_s").agg(
        F.count(F.lit(1)).alias("n"), F.max("ensemble_score").alias("best")
    )
    second, block = F.col("detected_s"), F.floor(F.col("detected_s") / lookback_s)
    own = F.struct(block.alias("block"), second.alias("at"), F.lit(True).alias("own"), F.col("n"), F.col("best"))
    # what the block before holds from `lookback_s` before the second on
    earlier = F.struct(
        (block - 1).alias("block"), (second - lookback_s).alias("at"), F.lit(False).alias("own"),
        F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(seconds.schema["best"].dataType).alias("best"),
    )
    placed = seconds.select(asset, "detected_s", F.explode(F.array(own, earlier)).alias("e")).select(
        asset, "detected_s", "e.*"
    )
    block_of = Window.partitionBy(asset, "block")
    start = block_of.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    end = block_of.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    context = (
        placed.withColumn("found", F.when(F.col("own"), F.sum("n").over(start)).otherwise(F.sum("n").over(end)))
        .withColumn("top", F.when(F.col("own"), F.max("best").over(start)).otherwise(F.max("best").over(end)))
        .groupBy(asset, "detected_s")
        .agg(F.coalesce(F.sum("found"), F.lit(0)).alias("prior_alerts"), F.max("top").alias("prior_best"))
    )
    return alerts.join(context, [asset, "detected_s"], "left")

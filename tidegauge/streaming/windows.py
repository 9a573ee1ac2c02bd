"""Window aggregates over a stream.

`stream_volume` and `stream_sessions` are native stateful aggregates: their state is a few numbers
per open window. The complete vectors need neighbouring messages and value counts, which would make
the state of a busy window grow with its traffic. `FeatureStream` therefore keeps open messages in
a table, partitioned by time, and computes the vectors of a window once, when the watermark passes
its end, with the batch operators.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import correlate as co
from tidegauge.operators.features import extract_features, volume_measures
from tidegauge.operators.windows import (
    DEFAULT_SIZES,
    MICROS,
    WINDOW,
    assign_windows,
    floor_to,
)


def stream_volume(
    messages: DataFrame, sizes: Sequence[int] = DEFAULT_SIZES, lateness_s: int = 60
) -> DataFrame:
    """Volume features and bounds of each window, emitted once when it closes (append mode).

    The watermark runs on the window ends. The end of the largest window lies up to its size
    ahead of the event, so that size is added to the allowed lateness.
    """
    windowed = assign_windows(messages, sizes).withColumn(
        "window_end", F.timestamp_seconds(F.col("window_start") + F.col("window_size"))
    )
    held = windowed.withWatermark("window_end", f"{max(sizes) + lateness_s} seconds")
    return held.groupBy(*WINDOW, "window_end").agg(
        *[c.alias(n) for n, c in volume_measures().items()],
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )


def stream_sessions(anomalies: DataFrame, gap_s: int = co.GAP_S, lateness_s: int = 60) -> DataFrame:
    """Incident bounds per correlation key, emitted when the gap has passed (append mode)."""
    stamped = co.drop_normal(anomalies).withColumn("ts", F.timestamp_seconds("detected_s"))
    return (
        stamped.withWatermark("ts", f"{lateness_s} seconds")
        .withColumn("correlation_key", co.correlation_key())
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


class FeatureStream:
    """A `foreachBatch` sink that turns flat messages into vectors of closed windows.

    Under `store` it keeps `messages` (open and recent ones), `progress` (one row per batch),
    `late` (a row for each window that had closed when a message came; it still counts in its windows
    that are open) and `vectors`. Every output of a batch lies in a folder of its own that a repeated batch overwrites, so a restart after a
    failure changes nothing.
    """

    def __init__(
        self, store: str, sizes: Sequence[int] = DEFAULT_SIZES, lateness_s: int = 60,
        slice_seconds: int | None = None,
    ) -> None:
        self.store = store
        self.sizes = tuple(int(s) for s in sizes)
        self.lateness_s = lateness_s
        self.slice_seconds = slice_seconds
        self.chunk_s = math.lcm(*self.sizes)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = self._watermark(spark, batch_id)
        ends = [floor_to(F.col("ts_us"), size) + size for size in self.sizes]
        counts = F.exists(F.array(*ends), lambda end: end > before)
        staged = batch.filter(F.col("ts_us").isNotNull()).withColumn(
            "chunk", floor_to(F.col("ts_us"), self.chunk_s)
        )
        # windows are emitted once, after their end: a message can't reach one that had closed before
        staged.filter(counts).write.mode("overwrite").partitionBy("chunk").parquet(
            self._folder("messages", batch_id)
        )
        missed = assign_windows(staged.drop("chunk"), self.sizes).filter(
            F.col("window_start") + F.col("window_size") <= before
        )
        missed.write.mode("overwrite").parquet(self._folder("late", batch_id))
        newest = staged.agg(F.max("ts_us")).first()[0]
        now = before if newest is None else max(before, newest // MICROS - self.lateness_s)
        spark.createDataFrame([(batch_id, now)], "batch_id bigint, watermark_s bigint").coalesce(
            1
        ).write.mode("overwrite").parquet(self._folder("progress", batch_id))
        if now > before:
            self._emit(spark, batch_id, before, now)

    def flush(self, spark: SparkSession, batch_id: int) -> None:
        """Close every window that is still open, for a stream that has ended."""
        self._emit(spark, batch_id, self._watermark(spark, batch_id), 1 << 40)

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.store}/vectors").drop("batch")

    def late(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.store}/late").drop("batch")

    def _emit(self, spark: SparkSession, batch_id: int, before: int, now: int) -> None:
        first_chunk = before - max(self.sizes) - self.chunk_s
        held = spark.read.option("mergeSchema", "false").parquet(f"{self.store}/messages")
        held = held.filter(
            (F.col("batch") <= batch_id) & (F.col("chunk") >= first_chunk) & (F.col("chunk") < now)
        ).drop("batch", "chunk")
        end = F.col("window_start") + F.col("window_size")
        closed = extract_features(held, self.sizes, self.slice_seconds).filter(
            (end > before) & (end <= now)
        )
        closed.write.mode("overwrite").parquet(self._folder("vectors", batch_id))

    def _watermark(self, spark: SparkSession, batch_id: int) -> int:
        """Where the batches before this one had got to."""
        if batch_id == 0:
            return 0
        known = spark.read.parquet(f"{self.store}/progress").filter(F.col("batch") < batch_id)
        return known.agg(F.max("watermark_s")).first()[0] or 0

    def _folder(self, name: str, batch_id: int) -> str:
        return f"{self.store}/{name}/batch={batch_id}"


__all__ = ["FeatureStream", "stream_sessions", "stream_volume"]

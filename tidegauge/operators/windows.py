"""Tumbling windows of several sizes, inter-arrival times, window bookkeeping."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOW = ["src_ip", "dst_ip", "protocol"]
WINDOW = [*FLOW, "window_size", "window_start"]
DEFAULT_SIZES = (60, 300, 900)
MICROS = 1_000_000


def floor_to(ts_us: Column, seconds: int | Column) -> Column:
    """Start, in epoch seconds, of the aligned span of that length."""
    whole = F.floor(ts_us / MICROS)
    return (whole - F.pmod(whole, F.lit(seconds) if isinstance(seconds, int) else seconds)).cast(
        "bigint"
    )


def assign_windows(df: DataFrame, sizes: Sequence[int] = DEFAULT_SIZES) -> DataFrame:
    """Each message once per size, with `window_size` and `window_start`."""
    exploded = df.withColumn("window_size", F.explode(F.array(*[F.lit(int(s)) for s in sizes])))
    return exploded.withColumn("window_start", floor_to(F.col("ts_us"), F.col("window_size")))


def _timed(messages: DataFrame, length: int) -> DataFrame:
    timed = F.col("ts_us").isNotNull()
    if "has_time" in messages.columns:  # arrival times stand in for windows, not for gaps
        timed = timed & F.col("has_time")
    return messages.filter(timed).select(*FLOW, "ts_us").withColumn("slice", floor_to(F.col("ts_us"), length))


def slice_gaps(messages: DataFrame, length: int) -> DataFrame:
    """Neighbouring messages of a flow inside time slices: `FLOW, slice, ts_us, prev_us`."""
    ordered = Window.partitionBy(*FLOW, "slice").orderBy("ts_us")
    paired = _timed(messages, length).withColumn("prev_us", F.lag("ts_us").over(ordered))
    return paired.filter(F.col("prev_us").isNotNull()).select(*FLOW, "slice", "ts_us", "prev_us")


def gap_edges(messages: DataFrame, length: int) -> DataFrame:
    """Neighbours across slice edges, from one (first, last) pair per slice: `FLOW, slice, ts_us, prev_us`."""
    edges = _timed(messages, length).groupBy(*FLOW, "slice").agg(
        F.min("ts_us").alias("ts_us"), F.max("ts_us").alias("last_us")
    )
    by_slice = Window.partitionBy(*FLOW).orderBy("slice")
    across = edges.withColumn("prev_us", F.lag("last_us").over(by_slice))
    return across.filter(F.col("prev_us").isNotNull()).select(*FLOW, "slice", "ts_us", "prev_us")


def inter_arrivals(
    messages: DataFrame,
    sizes: Sequence[int] = DEFAULT_SIZES,
    slice_seconds: int | None = None,
) -> DataFrame:
    """Microseconds between neighbouring messages of a flow: `FLOW, ts_us, prev_us`.

    The sort runs per flow *and* time slice, so a flow that carries a large part of all traffic
    is spread over as many tasks as it has slices. The default slice is the smallest size. The
    neighbours across slice edges come from one (first, last) pair per slice; slices whose
    length all sizes divide need none, as no window reaches over their edges.
    """
    length = slice_seconds or min(int(s) for s in sizes)
    inner = slice_gaps(messages, length).drop("slice")
    if length % math.lcm(*[int(s) for s in sizes]) == 0:
        return inner
    return inner.unionByName(gap_edges(messages, length).drop("slice"))


def window_bounds(windowed: DataFrame) -> DataFrame:
    """First and last event time and the count of every window."""
    return windowed.groupBy(*WINDOW).agg(
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("message_count"),
    )


def close_windows(windows: DataFrame, as_of_s: int) -> tuple[DataFrame, DataFrame]:
    """Windows whose end lies at or before `as_of_s`, and the ones still open."""
    closed = F.col("window_start") + F.col("window_size") <= as_of_s
    return windows.filter(closed), windows.filter(~closed)


def split_late(
    windowed: DataFrame, lateness_s: int, arrival: str = "arrival_us"
) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows that arrived after their window had closed.

    A row is late when it arrives more than `lateness_s` after the end of its window; the late
    ones form their own table instead of a second partial window under the same key.
    """
    end = F.col("window_start") + F.col("window_size") + lateness_s
    late = F.col(arrival) >= end * MICROS
    return windowed.filter(~late), windowed.filter(late)


def window_stats(windowed: DataFrame, as_of_s: int) -> DataFrame:
    """Open windows per size and the messages held in them."""
    _, still_open = close_windows(window_bounds(windowed), as_of_s)
    return still_open.groupBy("window_size").agg(
        F.count(F.lit(1)).alias("active_windows"),
        F.sum("message_count").alias("total_buffered_messages"),
    )

"""Further window features: diversity, bursts, registers, topology, scans, values, wide rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import names
from tidegauge.functions.stats import ENTROPY_EPSILON
from tidegauge.operators.features import timing_features
from tidegauge.operators.windows import DEFAULT_SIZES, MICROS, WINDOW, assign_windows, inter_arrivals

SPAN = ["window_size", "window_start"]


def diversity_features(windowed: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct sources, destinations, pairs and function codes of all traffic in a window.

    Exact counts first reduce the window to its distinct combinations before the shuffle;
    `approximate` keeps a sketch per window instead.
    """
    code = F.coalesce("function_code", F.when(F.lower("protocol") == "dnp3", F.col("dnp3_code")))
    if approximate:
        count: object = lambda *c: F.approx_count_distinct(F.struct(*c) if len(c) > 1 else c[0])
    else:
        count = lambda *c: F.count_distinct(*c)
    return windowed.withColumn("code", code).groupBy(*SPAN).agg(
        F.count(F.lit(1)).alias("msg_count"),
        F.sum(F.coalesce("payload_size", F.lit(0))).alias("bytes_total"),
        count(F.col("src_ip")).alias("unique_sources"),
        count(F.col("dst_ip")).alias("unique_destinations"),
        count(F.col("src_ip"), F.col("dst_ip")).alias("unique_pairs"),
        count(F.col("code")).alias("unique_function_codes"),
    )


def burst_features(
    messages: DataFrame, sizes: Sequence[int] = DEFAULT_SIZES, slice_seconds: int | None = None
) -> DataFrame:
    """Share of gaps below a tenth of the median, coefficient of variation, and 1/(1+cv).

    The last one stands in for a periodicity score, which has no published formula. The median
    is joined back to the gaps on the window key.
    """
    timing = timing_features(messages, sizes, slice_seconds).select(
        *WINDOW, "iat_mean", "iat_std", "iat_median"
    )
    pairs = (
        assign_windows(inter_arrivals(messages, sizes, slice_seconds), sizes)
        .filter(F.col("prev_us") >= F.col("window_start") * MICROS)
        # equal gaps of a window are merged, so the join sees few rows of a busy one
        .groupBy(*WINDOW, (F.col("ts_us") - F.col("prev_us")).alias("gap_us"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    short = F.sum(F.when(F.col("gap_us") / MICROS < F.col("iat_median") / 10, F.col("n")).otherwise(0))
    bursts = pairs.join(timing, WINDOW).groupBy(*WINDOW).agg(
        (short / F.sum("n")).alias("burst_score"),
        F.first("iat_mean").alias("iat_mean"),
        F.first("iat_std").alias("iat_std"),
    )
    cv = F.when(F.col("iat_mean") > 0, F.col("iat_std") / F.col("iat_mean")).otherwise(0.0)
    return bursts.withColumn("iat_cv", cv).select(
        *WINDOW, "burst_score", "iat_cv", (1 / (1 + F.col("iat_cv"))).alias("periodicity_score")
    )


def register_behaviour(windowed: DataFrame) -> DataFrame:
    reads = F.count_if(F.col("function_code").isin(names.MODBUS_READ))
    writes = F.count_if(F.col("function_code").isin(names.MODBUS_WRITE))
    errors = F.count_if(F.coalesce("is_exception", F.lit(False)))
    address = F.col("start_address")
    return windowed.groupBy(*WINDOW).agg(
        reads.alias("read_count"),
        writes.alias("write_count"),
        (reads / F.greatest(writes, F.lit(1))).alias("read_write_ratio"),
        errors.alias("error_count"),
        (errors / F.count(F.lit(1))).alias("error_rate"),
        F.count_distinct(address).alias("unique_registers"),
        F.coalesce(F.max(address) - F.min(address), F.lit(0)).alias("register_range"),
    )


def topology_features(windowed: DataFrame, known_pairs: DataFrame) -> DataFrame:
    """New pairs against a baseline, the share of them, and fan-out and fan-in of a window.

    `known_pairs(src_ip, dst_ip)`. The pairs of a window are made distinct first, so the join
    sees each once.
    """
    pairs = windowed.select(*SPAN, "src_ip", "dst_ip").distinct()
    known = known_pairs.select("src_ip", "dst_ip").distinct().withColumn("known", F.lit(True))
    marked = pairs.join(known, ["src_ip", "dst_ip"], "left")
    per_source = F.count(F.lit(1)) / F.count_distinct("src_ip")
    per_target = F.count(F.lit(1)) / F.count_distinct("dst_ip")
    new = F.count_if(F.col("known").isNull())
    return marked.groupBy(*SPAN).agg(
        new.alias("new_pairs_count"),
        (new / F.count(F.lit(1))).alias("topology_change_score"),
        per_source.alias("fan_out_ratio"),
        per_target.alias("fan_in_ratio"),
    )


def new_pairs(windowed: DataFrame, known_pairs: DataFrame) -> DataFrame:
    """The pairs themselves that the baseline does not know."""
    pairs = windowed.select("src_ip", "dst_ip").distinct()
    return pairs.join(known_pairs.select("src_ip", "dst_ip"), ["src_ip", "dst_ip"], "left_anti")


def ip_number(address: Column) -> Column:
    """IPv4 text as a number; NULL for other text."""
    parts = F.split(address, r"\.")
    total = F.lit(0).cast("bigint")
    for i in range(4):
        total = total * 256 + F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint")
    return total


def scan_score(
    windowed: DataFrame, min_destinations: int = 10, min_run: float = 0.5, max_duration_s: float = 60.0
) -> DataFrame:
    """Per source and window: 0.3 sequential targets, 0.3 many targets, 0.2 one code, 0.2 short.

    The rules come without cut-offs, so those are parameters. Targets are sequential when the
    distinct addresses fill at least `min_run` of the range they span.
    """
    number = ip_number(F.col("dst_ip"))
    code = F.coalesce(F.col("function_code"), F.lit(-1))
    found = windowed.groupBy("src_ip", *SPAN).agg(
        F.count_distinct("dst_ip").alias("destinations"),
        F.count_distinct(number).alias("numbers"),
        (F.max(number) - F.min(number) + 1).alias("reach"),
        F.count_distinct(code).alias("codes"),
        ((F.max("ts_us") - F.min("ts_us")) / MICROS).alias("duration_s"),
    )
    several = F.col("destinations") > 1
    points = (
        F.when(several & (F.col("numbers") / F.col("reach") >= min_run), 0.3).otherwise(0.0)
        + F.when(F.col("destinations") >= min_destinations, 0.3).otherwise(0.0)
        + F.when(F.col("codes") == 1, 0.2).otherwise(0.0)
        + F.when(F.col("duration_s") <= max_duration_s, 0.2).otherwise(0.0)
    )
    return found.select("src_ip", *SPAN, "destinations", points.alias("scan_score"))


def value_statistics(windowed: DataFrame, outlier_sigmas: float = 3.0) -> DataFrame:
    """Moments, entropy, range and outliers of the register values of a window.

    Values are counted per window and distinct value first; everything else is computed from
    those counts. Skewness needs more than two values, kurtosis more than three.
    """
    counted = (
        windowed.select(*WINDOW, F.explode("values").alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy(*WINDOW, "value")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    value, c = F.col("value").cast("double"), F.col("c")
    base = counted.groupBy(*WINDOW).agg(
        F.sum(c).alias("n"),
        (F.sum(value * c) / F.sum(c)).alias("mean"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    centred = counted.join(base, WINDOW).withColumn("d", value - F.col("mean"))
    power = lambda k: (F.sum(F.pow("d", F.lit(k)) * c) / F.sum(c)).alias(f"m{k}")
    share = c / F.col("n")
    moments = centred.groupBy(*WINDOW).agg(
        F.first("n").alias("value_count"),
        F.first("mean").alias("value_mean"),
        (F.first("high") - F.first("low")).alias("value_range"),
        power(2), power(3), power(4),
        (-F.sum(share * F.log2(share + ENTROPY_EPSILON))).alias("value_entropy"),
    )
    std = F.sqrt("m2")
    outlying = (
        centred.join(moments.select(*WINDOW, "m2"), WINDOW)
        .groupBy(*WINDOW)
        .agg(
            F.sum(F.when(F.abs("d") > outlier_sigmas * F.sqrt("m2"), c).otherwise(0)).alias(
                "out_of_range_count"
            )
        )
    )
    spread = F.col("m2") > 0
    return moments.join(outlying, WINDOW).select(
        *WINDOW,
        "value_count",
        "value_mean",
        std.alias("value_std"),
        F.when((F.col("value_count") > 2) & spread, F.col("m3") / F.pow(std, F.lit(3)))
        .otherwise(0.0).alias("value_skewness"),
        F.when((F.col("value_count") > 3) & spread, F.col("m4") / F.pow("m2", F.lit(2)) - 3)
        .otherwise(0.0).alias("value_kurtosis"),
        "value_entropy",
        "value_range",
        "out_of_range_count",
    )


def pivot_window_sizes(
    features: DataFrame, columns: Sequence[str], suffixes: dict[int, str]
) -> DataFrame:
    """One row per flow and smallest window, with the columns of every size side by side.

    Each larger window is read at the start it has for that smallest window, so the sizes are
    aligned; the sizes are given, so no extra pass looks for them.
    """
    sizes = sorted(suffixes)
    flow = ["src_ip", "dst_ip", "protocol"]
    smallest = features.filter(F.col("window_size") == sizes[0])
    wide = smallest.select(
        *flow, "window_start", *[F.col(c).alias(f"{c}_{suffixes[sizes[0]]}") for c in columns]
    )
    for size in sizes[1:]:
        larger = features.filter(F.col("window_size") == size).select(
            *flow,
            F.col("window_start").alias("_start"),
            *[F.col(c).alias(f"{c}_{suffixes[size]}") for c in columns],
        )
        aligned = F.col("window_start") - F.pmod(F.col("window_start"), F.lit(size))
        wide = wide.withColumn("_start", aligned).join(larger, [*flow, "_start"], "left").drop("_start")
    return wide


__all__ = [
    "burst_features", "diversity_features", "ip_number", "new_pairs",
    "pivot_window_sizes", "register_behaviour", "scan_score", "topology_features",
    "value_statistics",
]

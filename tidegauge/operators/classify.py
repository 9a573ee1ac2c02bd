"""Classification and explanation of scored vectors, as plain columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.names import TYPE_SEVERITY, TYPE_TECHNIQUE
from tidegauge.functions.ordered import exact_quantiles
from tidegauge.functions.text import lookup
from tidegauge.operators.prep import SERIES

# fixed values: score thresholds of the four classes
SUSPICIOUS, ANOMALY, CRITICAL = 0.4, 0.7, 0.9
TINY = 1e-10
# what the type heuristics look at; a NULL takes the default of the heuristic
TYPE_FEATURES = (
    "iat_mean", "iat_std", "iat_min", "iat_max", "message_count", "bytes_total", "bytes_mean",
    "bytes_std",
)


def classify(
    score: Column,
    suspicious: float | Column = SUSPICIOUS,
    anomaly: float | Column = ANOMALY,
    critical: float | Column = CRITICAL,
) -> Column:
    return (
        F.when(score >= critical, "critical")
        .when(score >= anomaly, "anomaly")
        .when(score >= suspicious, "suspicious")
        .otherwise("normal")
    )


def _known(name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def timing_score() -> Column:
    mean = _known("iat_mean", 1.0)
    spread = _known("iat_max", 0.0) - _known("iat_min", 0.0)
    floor = F.greatest(mean, F.lit(TINY))
    weighted = 0.5 * _known("iat_std", 0.0) / floor + F.least(spread / floor, F.lit(10.0)) / 20
    return F.when(mean < TINY, 0.0).otherwise(F.least(F.lit(1.0), weighted))


def volume_score() -> Column:
    count = _known("message_count", 0.0)
    points = (
        F.when(count > 1000, 0.4).when(count < 5, 0.2).otherwise(0.0)
        + F.when(_known("bytes_total", 0.0) > 1_000_000, 0.3).otherwise(0.0)
        + F.when(_known("bytes_std", 0.0) > 500, 0.3).otherwise(0.0)
    )
    return F.least(F.lit(1.0), points)


def recon_score() -> Column:
    count, mean = _known("message_count", 0.0), _known("iat_mean", 1.0)
    regular = (mean > 0) & (_known("iat_std", 0.0) / F.greatest(mean, F.lit(TINY)) < 0.1)
    points = (
        F.when((count > 100) & (_known("bytes_mean", 0.0) < 50), 0.5).otherwise(0.0)
        + F.when(regular, 0.3).otherwise(0.0)
        + F.when(count > 500, 0.2).otherwise(0.0)
    )
    return F.least(F.lit(1.0), points)


def identify_type(classification: Column) -> Column:
    """Best scoring kind (timing before volume before reconnaissance on ties); NULL if normal."""
    timing, volume, recon = timing_score(), volume_score(), recon_score()
    best = F.greatest(timing, volume, recon)
    return (
        F.when(classification == "normal", F.lit(None).cast("string"))
        .when(best < 0.3, "unknown")
        .when(timing == best, "timing_anomaly")
        .when(volume == best, "volume_anomaly")
        .otherwise("reconnaissance")
    )


def feature_contributions(stats: Mapping[str, tuple[float, float]]) -> Column:
    """Map of feature to min(1, |z|/3); features without a value are left out."""
    entries = []
    for name, (mean, std) in sorted(stats.items()):
        scale = std if std >= TINY else 1.0
        part = F.least(F.lit(1.0), F.abs((F.col(name).cast("double") - mean) / scale) / 3)
        entries.append(F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("k"), part.alias("v"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def top_contributors(contributions: Column, count: int = 5) -> Column:
    """Entries with the largest absolute values, largest first, names in order on ties."""
    ranked = F.array_sort(
        F.transform(
            F.map_entries(contributions),
            lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("key"), e["value"].alias("value")),
        )
    )
    return F.slice(
        F.transform(ranked, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))),
        1,
        count,
    )


# fixed values: lower bounds above which a feature counts as anomalous, by anomaly type
RULES: dict[str, dict[str, float]] = {
    "command_injection": {"fc_write_ratio": 0.5},
    "protocol_violation": {"exception_ratio": 0.10, "exception_count": 10},
    "unauthorized_access": {"addr_unique_count": 100, "unit_id_unique_count": 10},
    "data_exfiltration": {"fc_read_ratio": 0.95, "qty_mean": 50},
    "reconnaissance": {"fc_unique_count": 10, "addr_range": 1000, "fc_diagnostic_ratio": 0.5},
    "volume_anomaly": {"bytes_max": 1024},
    "timing_anomaly": {"iat_std": 1.0, "iat_max": 10.0},
}
# every bound must be passed for these; for the others one is enough
ALL_BOUNDS = ("data_exfiltration",)


# fixed values: multiples of the flow's baseline above which a feature counts as anomalous, by anomaly type
RELATIVE_RULES: dict[str, dict[str, float]] = {"volume_anomaly": {"message_count": 2.0, "bytes_total": 3.0}}
# fixed value: share of the baseline by which the message count may deviate before the timing counts as anomalous
COUNT_DEVIATION = 0.5
# fixed values: counts of addresses not in the baseline above which a window counts as anomalous, by anomaly type
ADDRESS_RULES: dict[str, dict[str, int]] = {
    "command_injection": {"new_write_addresses": 0}, "unauthorized_access": {"new_addresses": 0},
}


def flow_baseline(rows: DataFrame) -> DataFrame:
    """What is usual for each flow and window size: the means of the features that relative rules look at."""
    names = dict.fromkeys(n for bounds in RELATIVE_RULES.values() for n in bounds)
    return rows.groupBy(*SERIES).agg(*[F.avg(n).alias(f"baseline_{n}") for n in names])


def with_baseline(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Vectors with the columns of `flow_baseline`; a flow it does not know has nulls there and breaks no rule."""
    return rows.join(baseline, SERIES, "left")


def _relative(kind: str) -> list[Column]:
    usual = lambda name: F.col(f"baseline_{name}")
    passed = [F.col(n) > factor * usual(n) for n, factor in RELATIVE_RULES.get(kind, {}).items()]
    if kind == "timing_anomaly":
        count = F.col("message_count")
        passed.append(F.abs(count - usual("message_count")) > COUNT_DEVIATION * usual("message_count"))
    return passed


def rule_type(
    rules: Mapping[str, Mapping[str, float]] = RULES, relative: bool = False, addresses: Sequence[str] = ()
) -> Column:
    """First matching type in the order of the table, else `unknown`.

    With `relative`, for rows of `with_baseline`, a type also matches where a feature is out of
    proportion to the flow's own baseline. `addresses` names the columns of new addresses the rows have
    (`addresses.with_new_addresses`): `new_write_addresses`, `new_addresses`.
    """
    decided = None
    for kind, bounds in rules.items():
        passed = [F.coalesce(F.col(name) > bound, F.lit(False)) for name, bound in bounds.items()]
        hit = passed[0]
        for condition in passed[1:]:
            hit = (hit & condition) if kind in ALL_BOUNDS else (hit | condition)
        fresh = [F.col(n) > most for n, most in ADDRESS_RULES.get(kind, {}).items() if n in addresses]
        for condition in [*(_relative(kind) if relative else []), *fresh]:
            hit = hit | F.coalesce(condition, F.lit(False))
        decided = F.when(hit, kind) if decided is None else decided.when(hit, kind)
    return decided.otherwise("unknown")


def type_severity(anomaly_type: Column) -> Column:
    return lookup(TYPE_SEVERITY, F.lower(anomaly_type))


def mitre_technique(anomaly_type: Column) -> Column:
    return lookup(TYPE_TECHNIQUE, F.lower(anomaly_type))


# weights of a type inside the risk formula; the formula names them without giving values,
# so they follow the default severity of the type
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.75, "medium": 0.5}


def risk_severity(
    alerts: DataFrame, assets: DataFrame, repeats: str = "prior_alerts", repeat_limit: int = 10
) -> DataFrame:
    """0.4 score + 0.3 importance/5 + 0.2 type weight + 0.1 repeat, and its bucket.

    `assets(ip, importance)` is looked up by destination; the repeat part grows with the number
    of earlier alerts and is full at `repeat_limit`.
    """
    importance = assets.select(F.col("ip").alias("dst_ip"), F.col("importance"))
    weight = lookup(SEVERITY_WEIGHT, type_severity(F.coalesce("anomaly_type", F.lit("unknown"))), F.lit(0.5))
    risk = (
        0.4 * F.col("ensemble_score")
        + 0.3 * F.coalesce("importance", F.lit(1)) / 5
        + 0.2 * weight
        + 0.1 * F.least(F.col(repeats) / repeat_limit, F.lit(1.0))
    )
    scored = alerts.join(importance, "dst_ip", "left").withColumn("risk", risk)
    return scored.withColumn(
        "risk_level",
        F.when(F.col("risk") > 0.9, "critical")
        .when(F.col("risk") >= 0.7, "high")
        .when(F.col("risk") >= 0.4, "medium")
        .otherwise("low"),
    )


def adaptive_threshold(scores: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Score threshold per device and hour of day, and the number of scores it comes from."""
    hour = F.pmod(F.floor(F.col("detected_s") / 3600), F.lit(24)).cast("int")
    return exact_quantiles(
        scores.withColumn("hour", hour), "ensemble_score", {"threshold": quantile}, ["src_ip", "hour"]
    )


def apply_adaptive_threshold(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scores with the threshold of their device and hour, and whether they pass it."""
    hour = F.pmod(F.floor(F.col("detected_s") / 3600), F.lit(24)).cast("int")
    joined = scores.withColumn("hour", hour).join(
        thresholds.select("src_ip", "hour", "threshold"), ["src_ip", "hour"], "left"
    )
    return joined.withColumn(
        "over_threshold", F.coalesce(F.col("ensemble_score") > F.col("threshold"), F.lit(False))
    )


__all__ = [
    "adaptive_threshold", "apply_adaptive_threshold", "classify", "feature_contributions",
    "flow_baseline", "identify_type", "mitre_technique", "recon_score", "risk_severity", "rule_type",
    "timing_score", "top_contributors", "type_severity", "volume_score", "with_baseline",
]

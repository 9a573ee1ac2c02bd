"""Score evaluation, drift and data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.ordered import exact_quantiles, order_breaks, running_totals
from tidegauge.functions.stats import one_row
from tidegauge.functions.text import stable_share


def evaluate_scores(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of every model's scores, in one row."""
    return df.agg(*[
        c for m in models for c in (
            F.avg(m).alias(f"{m}_mean_score"), F.stddev_pop(m).alias(f"{m}_std_score")
        )
    ])


def precision_recall(df: DataFrame, score: str, label: str) -> DataFrame:
    """Precision, recall and F1 at every distinct score taken as threshold."""
    levels = df.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) != 1).alias("negatives"),
    )
    falling = levels.withColumn("_fall", -F.col(score))
    summed = running_totals(falling, "_fall", ["positives", "negatives"])
    totals = levels.agg(F.sum("positives").alias("p"), F.sum("negatives").alias("n")).first()
    positives, negatives = int(totals["p"] or 0), int(totals["n"] or 0)
    hit, wrong = F.col("running_positives"), F.col("running_negatives")
    precision = hit / (hit + wrong)
    recall = hit / F.lit(positives) if positives else F.lit(0.0)
    return summed.select(
        F.col(score).alias("threshold"),
        "positives",
        "negatives",
        precision.alias("precision"),
        recall.alias("recall"),
        (2 * precision * recall / (precision + recall + 1e-8)).alias("f1"),
        # pairs ordered right by this level; equal scores count half
        (F.col("negatives") * ((hit - F.col("positives")) + F.col("positives") / 2)).alias("pairs"),
        F.lit(float(positives * negatives)).alias("all_pairs"),
    )


def labelled_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """Score quantiles, the threshold of the best F1 with its figures, and ROC-AUC."""
    curve = precision_recall(df, score, label)
    # equal F1: the smallest threshold wins
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    found = curve.agg(
        best.alias("best"), (F.sum("pairs") / F.max("all_pairs")).alias("roc_auc")
    ).select(
        F.col("best.threshold").alias("optimal_threshold"), "best.precision", "best.recall", "best.f1",
        "roc_auc",
    )
    spread = df.agg(
        F.avg(score).alias("score_mean"),
        F.stddev_pop(score).alias("score_std"),
    )
    high = exact_quantiles(df, score, {"score_p95": 0.95, "score_p99": 0.99}).drop("samples")
    return one_row(spread, high, found)


def ks_drift(
    base: DataFrame, current: DataFrame, features: Sequence[str], threshold: float = 0.05
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per feature, its asymptotic p-value and the flag."""
    levels = _long(base, features, "base").unionByName(_long(current, features, "current"))
    levels = levels.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == "base").alias("base_n"),
        F.count_if(F.col("side") == "current").alias("current_n"),
    )
    totals = levels.groupBy("feature").agg(
        F.sum("base_n").alias("base_total"), F.sum("current_n").alias("current_total")
    )
    running = running_totals(levels, "value", ["base_n", "current_n"], by=["feature"])
    gap = F.abs(
        F.col("running_base_n") / F.col("base_total")
        - F.col("running_current_n") / F.col("current_total")
    )
    result = (
        running.join(totals, "feature")
        .withColumn("gap", gap)
        .groupBy("feature")
        .agg(
            F.max("gap").alias("ks_statistic"),
            F.first("base_total").alias("base_total"),
            F.first("current_total").alias("current_total"),
        )
    )
    size = F.sqrt(
        F.col("base_total") * F.col("current_total") / (F.col("base_total") + F.col("current_total"))
    )
    result = result.withColumn("p_value", kolmogorov_tail(F.col("ks_statistic") * size))
    return result.select(
        "feature", "ks_statistic", "p_value", (F.col("p_value") < threshold).alias("drift_detected")
    )


def drift_summary(drift: DataFrame) -> DataFrame:
    drifted = F.count_if("drift_detected")
    return drift.agg(
        F.count(F.lit(1)).alias("total_features"),
        drifted.alias("drifted_features"),
        (drifted / F.count(F.lit(1))).alias("drift_ratio"),
    )


def kolmogorov_tail(x: Column) -> Column:
    """2 sum (-1)^(j-1) exp(-2 j^2 x^2), the limit distribution's upper tail."""
    terms = F.sequence(F.lit(1), F.lit(100))
    total = F.aggregate(
        terms,
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * x * x),
    )
    return F.when(x < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * total)))


def _long(df: DataFrame, features: Sequence[str], side: str) -> DataFrame:
    values = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    unpivoted = values.unpivot([], list(features), "feature", "value")
    return unpivoted.filter(F.col("value").isNotNull()).withColumn("side", F.lit(side))


def dataset_quality(
    df: DataFrame, time: str, features: Sequence[str], label: str | None = None,
    source: str | None = None, order: str | None = None, span: int = 1_000_000,
) -> DataFrame:
    """One row of figures and `issues`, the rules that are broken.

    `order` is the position of a row in its source; it is needed for the check of time order.
    """
    n = F.count(F.lit(1))
    missing = {f: F.count_if(F.col(f).isNull()) / n for f in features}
    share = F.avg((F.col(label) == 1).cast("double")) if label else F.lit(None).cast("double")
    figures = df.agg(
        n.alias("rows"),
        F.count_if(F.col(time).isNull()).alias("null_times"),
        (F.count(time) - F.countDistinct(time)).alias("duplicate_times"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        share.alias("label_share"),
        *[c.alias(f"_missing_{f}") for f, c in missing.items()],
    )
    if order:
        single = df if source else df.withColumn("_source", F.lit(0))
        breaks = order_breaks(single, time, [source or "_source"], order, span)
        figures = one_row(figures, breaks.agg(F.sum("order_breaks").alias("order_breaks")))
    else:
        figures = figures.withColumn("order_breaks", F.lit(0))
    rule = lambda broken, text: F.when(F.coalesce(broken, F.lit(False)), F.lit(text))
    issues = F.array_compact(F.array(
        rule(F.col("null_times") > 0, "missing_timestamps"),
        rule(F.col("duplicate_times") > 0, "duplicate_timestamps"),
        rule(F.col("order_breaks") > 0, "timestamps_not_monotonic"),
        *[rule(F.col(f"_missing_{f}") > 0.01, f"missing_rate_{f}") for f in features],
        rule((F.col("label_share") < 0.001) | (F.col("label_share") > 0.5), "label_share"),
    ))
    return (
        figures.withColumn("issues", issues)
        .withColumn("valid", F.size("issues") == 0)
        .drop(*[f"_missing_{f}" for f in features])
    )


def rebalance(
    df: DataFrame, label: str, normal_share: float, keys: Sequence[str], seed: int = 0
) -> DataFrame:
    """All anomalous rows and a stable share of the normal ones."""
    kept = stable_share(seed, *keys) < normal_share
    return df.filter((F.col(label) == 1) | kept)


def normal_only(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label) != 1)


def retrain_triggers(
    baseline: DataFrame, current: DataFrame, drift: DataFrame, max_drop: float = 0.10
) -> DataFrame:
    """Per model: did F1 fall by more than the allowed share, is there drift, retrain or not.

    `baseline(model, f1)`, `current(model, f1)` and the result of `ks_drift`.
    """
    was = baseline.select("model", F.col("f1").alias("baseline_f1"))
    now = current.select("model", F.col("f1").alias("current_f1"))
    drifted = drift.agg(F.max("drift_detected").alias("drift"))
    joined = was.join(now, "model").withColumn("_one", F.lit(1)).join(
        drifted.withColumn("_one", F.lit(1)), "_one"
    ).drop("_one")
    drop = (F.col("baseline_f1") - F.col("current_f1")) / F.col("baseline_f1")
    return joined.withColumn("degraded", drop > max_drop).withColumn(
        "retrain", F.col("degraded") | F.col("drift")
    )

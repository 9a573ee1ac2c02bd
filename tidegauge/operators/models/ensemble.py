"""Weighted ensemble over the models that answered."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.stats import clamp01

# fixed values: weights of the three models
WEIGHTS = {"isolation_forest": 0.3, "lstm_autoencoder": 0.5, "one_class_svm": 0.2}


def ensemble_score(scores: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted mean; a model without a score takes its weight out, none at all gives NULL."""
    used = {m: c for m, c in scores.items() if m in weights}
    total = sum((F.coalesce(c * weights[m], F.lit(0.0)) for m, c in used.items()), F.lit(0.0))
    weight = sum(
        (F.when(c.isNotNull(), F.lit(weights[m])).otherwise(0.0) for m, c in used.items()), F.lit(0.0)
    )
    return F.when(weight > 0, total / weight)


def confidence(scores: Mapping[str, Column]) -> Column:
    """1 - 2 * population deviation of the scores: 1 when the models agree, 0 when they are as
    far apart as scores can be. Nothing defines this figure elsewhere; this is our choice."""
    present = F.array_compact(F.array(*scores.values()))
    n = F.size(present)
    mean = F.aggregate(present, F.lit(0.0), lambda a, v: a + v) / n
    variance = F.aggregate(present, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    return F.when(n > 0, clamp01(1 - 2 * F.sqrt(variance)))


def model_scores(
    scores: Mapping[str, Column], raw: Mapping[str, Column] | None = None,
    weights: Mapping[str, float] = WEIGHTS,
) -> Column:
    """One entry per model that answered; timing is not measured per row."""
    raw = raw or {}
    entries = [
        F.when(
            c.isNotNull(),
            F.struct(
                F.lit(m).alias("model_name"),
                c.alias("score"),
                F.lit(float(weights.get(m, 0.0))).alias("weight"),
                raw.get(m, c).alias("raw_score"),
                F.lit(None).cast("double").alias("inference_time_ms"),
            ),
        )
        for m, c in scores.items()
    ]
    return F.array_compact(F.array(*entries))

"""The jobs of the stages, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import classify as cl
from tidegauge.operators import correlate as co
from tidegauge.operators import dedup, envelope, escalate, evaluate, features, packets, prep
from tidegauge.operators.models.boundary import Boundary, fit_boundary
from tidegauge.operators.models.ensemble import WEIGHTS, confidence, ensemble_score, model_scores
from tidegauge.operators.models.forest import Forest, fit_forest
from tidegauge.operators.models.recon import Reconstruction, fit_reconstruction
from tidegauge.operators.windows import DEFAULT_SIZES, FLOW, WINDOW
from tidegauge.session import materialise

MODELS = tuple(WEIGHTS)


def packets_to_messages(raw: DataFrame, compat_zero_bytes: bool = False) -> tuple[DataFrame, DataFrame]:
    """Watched packets decoded into messages, and the dropped ones with the reason."""
    kept, dropped = envelope.route_by_protocol(packets.filter_packets(packets.label_protocol(raw)))
    return envelope.to_envelope(kept, compat_zero_bytes), dropped


def packets_to_features(
    raw: DataFrame, sizes: Sequence[int] = DEFAULT_SIZES, slice_seconds: int | None = None,
    store: str | None = None,
) -> DataFrame:
    """Packets to window vectors.

    With `store`, a folder all executors reach (`shared_dir` names the cluster's), the decoded
    messages are written there once; the three aggregates of `extract_features` then read only
    their columns instead of decoding again.
    """
    messages, _ = packets_to_messages(raw)
    flat = envelope.flatten_envelope(messages)
    if store:
        flat = materialise(flat, store, "messages")
    return features.extract_features(flat, sizes, slice_seconds)


@dataclass(frozen=True)
class Artifacts:
    """Everything scoring needs; each part has a size fixed by its parameters."""

    scaler: prep.Scaler
    forest: Forest | None = None
    boundary: Boundary | None = None
    recon: Reconstruction | None = None
    sequence_length: int = prep.SEQUENCE_LENGTH

    def save(self, spark: SparkSession, path: str) -> None:
        prep.save_scaler(spark, self.scaler, f"{path}/scaler")
        for name in ("forest", "boundary", "recon"):
            part = getattr(self, name)
            if part is not None:
                part.save(spark, f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, sequence_length: int = prep.SEQUENCE_LENGTH) -> Artifacts:
        return Artifacts(
            prep.load_scaler(spark, f"{path}/scaler"), Forest.load(spark, f"{path}/forest"),
            Boundary.load(spark, f"{path}/boundary"), Reconstruction.load(spark, f"{path}/recon"),
            sequence_length,
        )


def train(
    rows: DataFrame, names: Sequence[str] | None = None, validation: float = 0.2, seed: int = 0,
    trees: int = 100, steps: int = 30, sequence_length: int = prep.SEQUENCE_LENGTH,
) -> tuple[Artifacts, DataFrame]:
    """Split, scale, fit the three models; returns them with the figures of the validation part."""
    training, held = prep.random_split(rows, validation, seed)
    scaler = prep.fit_scaler(training, names or prep.feature_names(rows))
    scaled = prep.scale(training, scaler).select(*WINDOW, "scaled").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        artifacts = Artifacts(
            scaler,
            fit_forest(scaled, trees=trees, seed=seed),
            fit_boundary(scaled, steps=steps, seed=seed),
            fit_reconstruction(prep.training_sequences(scaled, sequence_length)),
            sequence_length,
        )
    finally:
        scaled.unpersist()
    return artifacts, evaluate.evaluate_scores(model_columns(held, artifacts), MODELS)


def model_columns(rows: DataFrame, artifacts: Artifacts) -> DataFrame:
    """Vectors with one score column per model; a model that is not fitted gives NULL."""
    scaled = prep.scale(rows, artifacts.scaler)
    if artifacts.recon is not None:
        scaled = prep.rolling_sequences(scaled, artifacts.sequence_length)
    point = F.col("scaled")
    absent = F.lit(None).cast("double")
    scored = scaled.withColumns({
        "isolation_forest": artifacts.forest.score(point) if artifacts.forest else absent,
        "lstm_autoencoder": artifacts.recon.score(F.col("sequence")) if artifacts.recon else absent,
        "one_class_svm": artifacts.boundary.score(point) if artifacts.boundary else absent,
    })
    return scored.drop("scaled", "sequence")


def score_features(rows: DataFrame, artifacts: Artifacts) -> DataFrame:
    """Vectors to anomaly records: models, ensemble, class, type and contributions.

    The anomaly is detected, in event time, when its window ends.
    """
    expected = [*cl.TYPE_FEATURES, *artifacts.scaler.names]
    absent = {n: F.lit(None).cast("double") for n in expected if n not in rows.columns}
    scored = model_columns(rows.withColumns(absent) if absent else rows, artifacts)
    scores = {m: F.col(m) for m in MODELS}
    scored = scored.withColumns({
        "ensemble_score": ensemble_score(scores),
        "confidence": confidence(scores),
        "model_scores": model_scores(scores),
    })
    scored = scored.withColumn("classification", cl.classify(F.col("ensemble_score")))
    return scored.select(
        *WINDOW,
        (F.col("window_start") + F.col("window_size")).alias("detected_s"),
        F.concat_ws(":", *WINDOW).alias("anomaly_id"),
        "model_scores", "ensemble_score", "classification",
        cl.identify_type(F.col("classification")).alias("anomaly_type"),
        "confidence",
        cl.feature_contributions(artifacts.scaler.stats()).alias("feature_contributions"),
    )


def alerting(
    anomalies: DataFrame, gap_s: int = co.GAP_S, ttl_s: int = dedup.TTL_S,
    rules: escalate.Escalation = escalate.Escalation(), key_columns: Sequence[str] = FLOW,
    store: str | None = None, releases: DataFrame | None = None, closures: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anomalies to alerts (with `suppressed` and `priority`), incidents and escalations.

    `releases(dedup_key, released_s)` free keys and `closures(correlation_key, closed_s)` end incidents before their time
    (`lifecycle.releases_of`, `closures_of`). With `store` the handled alerts are written once and all three results read them.
    """
    found = co.to_alerts(co.correlate(co.drop_normal(anomalies), gap_s, key_columns, closures))
    freed = None if releases is None else releases.select("dedup_key", "released_s").distinct()
    handled = dedup.suppress_duplicates(found, ttl_s, releases=freed)
    if store:
        handled = materialise(handled, store, "handled")
    if "dst_ip" in key_columns:  # one target per incident: the rule cannot fire
        rules = escalate.Escalation(rules.p3, rules.p2, rules.p1, rules.critical_severity, False)
    incidents = co.incident_rollup(handled)
    priority = escalate.incident_priority(handled, rules)
    incidents = incidents.join(priority, "incident_id", "left").withColumn(
        "priority", F.coalesce("priority", F.lit("P4"))
    )
    return escalate.escalate(handled, rules), incidents, escalate.escalation_events(handled, rules)

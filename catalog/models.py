"""The outlier models on all vectors of the month, with their own defaults, and the whole way to alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.features import feature_rows
from catalog.registry import query
from catalog.views import ANOMALIES_SQL, GAP_S, TTL_S, anomalies, comparable, table
from tidegauge.operators import prep
from tidegauge.operators.models import ensemble
from tidegauge.operators.models.boundary import fit_boundary
from tidegauge.operators.models.forest import fit_forest
from tidegauge.operators.models.recon import fit_reconstruction
from tidegauge.operators.windows import WINDOW
from tidegauge.plans import jobs
from tidegauge.session import materialise, shared_dir


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of all window sizes, written once: fits pass over them many times."""
    return materialise(feature_rows(spark, sf_dir), shared_dir(spark), "vectors")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of all vectors, scaled."""
    rows = vectors(spark, sf_dir)
    return prep.scale(rows, prep.fit_scaler(rows)).select(*WINDOW, "scaled")


@query()
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    model = fit_forest(rows, seed=1)
    return comparable(rows.select(*WINDOW, model.score(F.col("scaled")).alias("score")))


@query()
def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    model = fit_boundary(rows, seed=1)
    return comparable(rows.select(*WINDOW, model.score(F.col("scaled")).alias("score")))


@query()
def reconstruction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    model = fit_reconstruction(prep.training_sequences(rows))
    found = prep.rolling_sequences(rows)
    return comparable(found.select(*WINDOW, model.score(F.col("sequence")).alias("score")))


@query()
def embedding_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest on the dense vectors of the `embeddings` table."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("scaled")
    )
    model = fit_forest(rows, seed=1, keys=["vec_id"])
    return comparable(rows.select("vec_id", model.score(F.col("scaled")).alias("score")))


@query(f"""
WITH {ANOMALIES_SQL},
three AS (
  SELECT anomaly_id, ensemble_score AS a, CASE WHEN anomaly_id % 3 = 0 THEN NULL ELSE confidence END AS b,
         CASE WHEN anomaly_id % 5 = 0 THEN NULL ELSE (anomaly_id % 100) / 100.0 END AS c FROM anomalies),
counted AS (
  SELECT *, (0.3 * a + coalesce(0.5 * b, 0) + coalesce(0.2 * c, 0))
           / (0.3 + CASE WHEN b IS NULL THEN 0 ELSE 0.5 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END) AS e,
         1 + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n,
         a + coalesce(b, 0) + coalesce(c, 0) AS s,
         a * a + coalesce(b * b, 0) + coalesce(c * c, 0) AS q FROM three)
SELECT anomaly_id, round(CAST(e AS DOUBLE), 6) AS ensemble,
       round(CAST(1 - 2 * sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS DOUBLE), 2) AS confidence,
       CAST(n AS BIGINT) AS models
FROM counted""")
def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean, agreement and number of the models that answered."""
    rows = anomalies(spark, sf_dir)
    scores = {
        "isolation_forest": F.col("ensemble_score"),
        "lstm_autoencoder": F.when(F.col("anomaly_id") % 3 != 0, F.col("confidence")),
        "one_class_svm": F.when(F.col("anomaly_id") % 5 != 0, F.col("anomaly_id") % 100 / 100),
    }
    return rows.select(
        "anomaly_id",
        F.round(ensemble.ensemble_score(scores), 6).alias("ensemble"),
        F.round(ensemble.confidence(scores), 2).alias("confidence"),
        F.size(ensemble.model_scores(scores)).cast("bigint").alias("models"),
    )


def _artifacts(rows: DataFrame) -> jobs.Artifacts:
    return jobs.train(rows, seed=1)[0]


@query()
def score_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the vectors and score them."""
    rows = vectors(spark, sf_dir)
    scored = jobs.score_features(rows, _artifacts(rows))
    return comparable(scored.select(
        *WINDOW, "ensemble_score", "classification", "anomaly_type", "confidence",
        F.size("model_scores").alias("models"), F.size("feature_contributions").alias("explained"),
    ))


@query()
def events_to_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From messages over vectors and scores to incidents with priorities."""
    rows = vectors(spark, sf_dir)
    _, incidents, _ = jobs.alerting(
        jobs.score_features(rows, _artifacts(rows)), gap_s=GAP_S * 10, ttl_s=TTL_S
    )
    return comparable(incidents.select(
        "correlation_key", "incident_id", "anomaly_count", "max_ensemble_score", "priority", "title"
    ))

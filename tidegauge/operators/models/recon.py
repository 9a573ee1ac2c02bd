"""Sequence reconstruction: a linear autoencoder over flattened sequences.

Principal components are the optimal linear encoder and decoder; the part of a sequence they
cannot rebuild is its error. The covariance is summed over the rows by Spark, only a matrix of
fixed size (sequence length times features, squared) reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = 8
THRESHOLD_QUANTILE = 0.95


@dataclass(frozen=True)
class Reconstruction:
    mean: np.ndarray
    components: np.ndarray  # dimensions x k
    threshold: float

    def error(self, flat: Column) -> Column:
        """Mean squared error of the rebuilt sequence."""
        mean, components = self.mean, self.components

        @F.pandas_udf("double")
        def rebuild(rows: pd.Series) -> pd.Series:
            if len(rows) == 0:
                return pd.Series([], dtype="float64")
            x = np.stack(rows.to_numpy()) - mean
            code = x @ components
            rest = (x * x).sum(axis=1) - (code * code).sum(axis=1)
            return pd.Series(np.maximum(rest, 0.0) / x.shape[1])

        return rebuild(flat)

    def score_of(self, error: Column) -> Column:
        return 1 - F.exp(-error / self.threshold)

    def score(self, sequence: Column) -> Column:
        """1 - exp(-mse/threshold) in [0, 1)."""
        return self.score_of(self.error(F.flatten(sequence)))

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.mean.tolist(), self.components.ravel().tolist(), self.threshold)
        schema = "mean array<double>, components array<double>, threshold double"
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Reconstruction:
        row = spark.read.parquet(path).first()
        mean = np.array(row["mean"])
        return Reconstruction(mean, np.array(row["components"]).reshape(len(mean), -1), row["threshold"])


def fit_reconstruction(
    df: DataFrame, components: int = COMPONENTS, sequence: str = "sequence"
) -> Reconstruction:
    """Fit on `sequence`; the threshold is the 95th percentile of the training error."""
    rows = df.select(F.flatten(sequence).alias("flat")).withColumn("vector", array_to_vector("flat"))
    mean = np.array(rows.agg(Summarizer.mean(F.col("vector")).alias("m")).first()["m"].toArray())
    k = min(components, len(mean))
    fitted = PCA(k=k, inputCol="vector", outputCol="code").fit(rows)
    model = Reconstruction(mean, fitted.pc.toArray(), 1.0)
    errors = rows.select(model.error(F.col("flat")).alias("e"))
    edge = errors.agg(F.percentile_approx("e", THRESHOLD_QUANTILE, 10000)).first()[0]
    return Reconstruction(mean, model.components, max(float(edge), 1e-9))

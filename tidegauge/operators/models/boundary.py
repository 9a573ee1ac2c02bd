"""One-class boundary in a random feature space.

The kernel machine is re-expressed so that it trains on any number of rows: random Fourier
features (Rahimi and Recht 2007) approximate the Gaussian kernel, and the one-class objective
(Scholkopf et al. 2001) is minimised by subgradient steps. A step is one Spark aggregation: each
task sums its rows, only sums of fixed length leave it. Vectors reach numpy as one Arrow buffer a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NU, WIDTH, STEPS = 0.1, 128, 30


@dataclass(frozen=True)
class Boundary:
    directions: np.ndarray  # features x width
    phases: np.ndarray
    weights: np.ndarray
    offset: float
    spread: float

    def decision(self, x: np.ndarray) -> np.ndarray:
        return _lift(x, self.directions, self.phases) @ self.weights - self.offset

    def score(self, vector: Column) -> Column:
        """sigmoid(-distance) in [0, 1]; 0.5 lies on the boundary."""
        model = self

        @F.arrow_udf("double")
        def outside(vectors: pa.Array) -> pa.Array:
            if len(vectors) == 0:
                return pa.array([], type=pa.float64())
            distance = model.decision(_matrix(vectors)) / model.spread
            return pa.array(1.0 / (1.0 + np.exp(np.clip(distance, -50, 50))))

        return outside(vector)

    def save(self, spark: SparkSession, path: str) -> None:
        row = (
            self.directions.ravel().tolist(), self.phases.tolist(), self.weights.tolist(),
            self.offset, self.spread,
        )
        schema = (
            "directions array<double>, phases array<double>, weights array<double>, "
            "offset double, spread double"
        )
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boundary:
        row = spark.read.parquet(path).first()
        width = len(row["phases"])
        return Boundary(
            np.array(row["directions"]).reshape(-1, width), np.array(row["phases"]),
            np.array(row["weights"]), row["offset"], row["spread"],
        )


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors as rows, without a Python object for each."""
    x = vectors.flatten().to_numpy(zero_copy_only=False)
    width = len(vectors[0]) if vectors.null_count == 0 else 0
    if x.size != len(vectors) * width or not (np.diff(vectors.offsets) == width).all():
        raise ValueError("vectors have to be of one length, and none may be null")
    return x.reshape(-1, width)


def _lift(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phases)) * np.cos(x @ directions + phases)


def fit_boundary(
    df: DataFrame, nu: float = NU, width: int = WIDTH, steps: int = STEPS, seed: int = 0
) -> Boundary:
    """Fit on the `scaled` vectors; every row takes part in every step."""
    rows = df.select("scaled").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(rows, nu, width, steps, seed)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, nu: float, width: int, steps: int, seed: int) -> Boundary:
    sums = rows.select(
        F.size("scaled").alias("d"),
        F.aggregate("scaled", F.lit(0.0), lambda a, v: a + v).alias("s"),
        F.aggregate("scaled", F.lit(0.0), lambda a, v: a + v * v).alias("q"),
    ).agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    found = sums.first()
    n, d = int(found["n"]), int(found["d"])
    mean = found["s"] / (n * d)
    variance = max(found["q"] / (n * d) - mean * mean, 1e-12)
    gamma = 1.0 / (d * variance)  # the usual "scale" width of the kernel
    rng = np.random.default_rng(seed)
    directions = rng.normal(0.0, np.sqrt(2.0 * gamma), (d, width))
    phases = rng.uniform(0.0, 2.0 * np.pi, width)

    weights, offset = _sums(rows, directions, phases, None, 0.0)[0] / n, 0.0
    offset = 0.5 * float(weights @ weights)
    for step in range(1, steps + 1):
        pulled, violating, _, _ = _sums(rows, directions, phases, weights, offset)
        rate = 1.0 / (step + 1)
        weights = weights - rate * (weights - pulled / (nu * n))
        offset = offset - rate * (violating / (nu * n) - 1.0) * float(weights @ weights)
    _, _, total, squares = _sums(rows, directions, phases, weights, offset)
    spread = float(np.sqrt(max(squares / n - (total / n) ** 2, 1e-12)))
    return Boundary(directions, phases, weights, float(offset), spread)


def _sums(rows: DataFrame, directions, phases, weights, offset) -> tuple:
    """Sum of the violating lifted rows, their number, and the sums of f and f^2 over all rows."""
    width = len(phases)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width + 3)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = _lift(_matrix(batch.column(0)), directions, phases)
            if weights is None:
                out[:width] += z.sum(axis=0)
                continue
            f = z @ weights
            bad = f < offset
            out[:width] += bad @ z
            out[width:] += (bad.sum(), f.sum(), (f * f).sum())
        yield pa.RecordBatch.from_pydict({"position": np.arange(width + 3, dtype=np.int32), "part": out})

    parts = rows.mapInArrow(partial, "position int, part double").groupBy("position").agg(F.sum("part").alias("part"))
    summed = np.zeros(width + 3)
    for position, part in parts.collect():  # width + 3 numbers
        summed[position] = part
    return summed[:width], summed[width], summed[width + 1], summed[width + 2]

"""Centroid clustering in whole numbers, with Ptolemaic pivots.

For points x, c and pivots p, s Ptolemy's inequality gives d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s). The
distances of all vectors to the pivots are taken once and stored beside them; a round adds those of its few centroids. A
centroid whose bound, rounded down, exceeds the distance to the most promising one can't be nearest; all others are
compared exactly, in 64-bit integers. Rounds send the driver one sum per centroid and dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import give_back, pick, run_folder, stored

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
MOST = 1 << 26  # entries beyond this would overflow exact squared distances
_EPS = np.finfo(np.float64).eps


def pivot_pairs(count: int) -> list[tuple[int, int]]:
    """Each pivot with the next one and with the one opposite."""
    return sorted({tuple(sorted((n, (n + step) % count))) for n in range(count) for step in {1, count // 2} if step % count})


def exact_distance(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared, in longs."""
    apart = x - centroid
    return np.einsum("ij,ij->i", apart, apart)


def to_points(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances (not squared) of all rows to a few points: the nearest doubles of the roots of exact squares."""
    return np.sqrt(np.stack([exact_distance(x, p) for p in points], axis=1).astype(np.float64))


def lower_bounds(far: np.ndarray, centroid_far: np.ndarray, pivot_far: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Squared distances that no centroid can be nearer than, rows by centroids.

    Each product of two rounded roots is off by less than 3 units of rounding, each later step by one; eight units of both
    products and of the square are taken off.
    """
    best = np.zeros((len(far), len(centroid_far)))
    for p, s in pairs:
        if not pivot_far[p, s]:
            continue
        one, two = far[:, p, None] * centroid_far[None, :, s], far[:, s, None] * centroid_far[None, :, p]
        np.maximum(best, (np.abs(one - two) - 8 * _EPS * (one + two)) / pivot_far[p, s], out=best)
    return best * best * (1 - 16 * _EPS)


class Assigner:
    """Nearest centroids of batches of vectors, ties to the smaller number."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids, self.pairs = centroids, pivot_pairs(len(pivots))
        self.centroid_far, self.pivot_far = to_points(centroids, pivots), to_points(pivots, pivots)

    def __call__(self, x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the nearest centroids and the exact squared distances."""
        bounds = lower_bounds(far, self.centroid_far, self.pivot_far, self.pairs)
        chosen = bounds.argmin(axis=1)
        apart = x - self.centroids[chosen]
        least = np.einsum("ij,ij->i", apart, apart)
        first = chosen.copy()
        for k, centroid in enumerate(self.centroids):
            left = np.flatnonzero((bounds[:, k] <= least) & (first != k))
            if not len(left):
                continue
            d = exact_distance(x[left], centroid)
            nearer = (d < least[left]) | ((d == least[left]) & (k < chosen[left]))
            least[left[nearer]], chosen[left[nearer]] = d[nearer], k
        return chosen, least


def _entries(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def _far_from(pivots: np.ndarray, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = to_points(_entries(batch.column(1), pivots.shape[1]), pivots)
            ends = pa.array(np.arange(0, far.size + 1, far.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], names=names)

    return measure


def _summed(assign: Assigner) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: how many vectors went to each centroid and their sums by dimension."""
    k, size = assign.centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
        for batch in batches:
            x = _entries(batch.column(1), size)
            chosen, _ = assign(x, _far(batch.column(2), len(x)))
            for n in np.unique(chosen):
                mine = x[chosen == n]
                count[n] += len(mine)
                total[n] += mine.sum(axis=0)
        cluster, at = np.nonzero(np.repeat(count[:, None], size, axis=1))
        yield pa.RecordBatch.from_arrays([
            pa.array(cluster, pa.int32()), pa.array(at, pa.int32()),
            pa.array(count[cluster]), pa.array(total[cluster, at]),
        ], names=["cluster", "at", "n", "total"])

    return add_up


def _far(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _placed(assign: Assigner) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _entries(batch.column(1), assign.centroids.shape[1])
            chosen, least = assign(x, _far(batch.column(2), len(x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chosen, pa.int32()), pa.array(least)], names=["vec_id", "cluster", "distance"]
            )
        give_back()

    return place


def _moved(vectors: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Floors of the means of the vectors nearest to each centroid; empty ones stay where they are."""
    parts = vectors.mapInArrow(_summed(Assigner(centroids, pivots)), "cluster int, at int, n long, total long")
    wide = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), wide).collect():
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def whole_vectors(df: DataFrame, vector: str, vec_id: str, size: int, scale: int) -> DataFrame:
    """(vec_id, x): the rows whose vector has `size` entries, none null or non-finite, as floor(scale * entry)."""
    entries = pick(vector).cast("array<double>")
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    fits = F.forall(entries, lambda c: F.abs(c * scale) <= MOST)
    x = F.when(fits, F.transform(entries, lambda c: F.floor(c * scale).cast("int")))
    too_large = F.raise_error(F.lit(f"vector entries times {scale} must not exceed {MOST}: squared distances are longs"))
    return df.filter((F.size(entries) == size) & good).select(
        pick(vec_id).alias("vec_id"), F.coalesce(x, too_large.cast("array<int>")).alias("x")
    )


def cluster(
    df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    size: int = DIMENSIONS, scale: int = SCALE, seed: int = 3,
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: one row per vector.

    Vectors of another length than `size`, null ones and those with a null, NaN or infinite entry are dropped; entries count
    as floor(scale * entry), and an entry beyond MOST after scaling ends the job with an error, as longs could not hold its
    squared distances. The first centroids are the vectors with the smallest SHA-256 of "<seed>:<vec_id>" (a null id counts
    as empty text; ties go by the entries), fewer if there are fewer vectors. Repeated rows are vectors of their own: they
    may start several centroids on one spot, of which the smaller number gets the vectors. An empty table gives no rows.
    Other columns are not read.
    """
    spark = df.sparkSession
    folder = run_folder(spark) + "/clusters"
    kind = df.select(pick(vec_id).alias("vec_id")).schema["vec_id"].dataType.simpleString()
    vectors = whole_vectors(df, vector, vec_id, size, scale)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.orderBy(F.sha2(name.cast("binary"), 256), "x").limit(clusters).collect()
    if not first:
        schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    centroids = np.array([r["x"] for r in first], dtype=np.int64)
    pivots = centroids.copy()
    far = vectors.mapInArrow(_far_from(pivots, ["vec_id", "x", "far"]), f"vec_id {kind}, x array<int>, far array<double>")
    held = stored(far, f"{folder}/vectors")
    for _ in range(rounds):
        moved = _moved(held, centroids, pivots)
        if np.array_equal(moved, centroids):
            break  # no later round can change anything
        centroids = moved
    placed = held.mapInArrow(_placed(Assigner(centroids, pivots)), f"vec_id {kind}, cluster int, distance long")
    placed = stored(placed, f"{folder}/placed")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    inertia = {r["cluster"]: int(r["inertia"]) for r in sums}
    digest = {k: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for k, c in enumerate(centroids)}
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for k in inertia for x in (k, values[k])]), F.col("cluster"))
    return placed.select(
        "vec_id", "cluster", "distance", of(inertia).cast("bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), of(digest).alias("centroid_sha256"),
    )

"""Isolation forest (Liu, Ting and Zhou 2008).

Every tree sees a small sample, so sampling and assigning rows to trees is a Spark job, a tree is
grown inside one task from at most `sample` rows, and the whole forest has a fixed size bound:
`trees * (2 * sample - 1)` nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.operators.windows import WINDOW

TREES, SAMPLE = 100, 256
NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, size int"
_SPACE = 1 << 40


@dataclass(frozen=True)
class Forest:
    """Node arrays per tree; a leaf has feature -1."""

    nodes: pd.DataFrame

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        return Forest(_ordered(spark.read.parquet(path).toPandas()))

    def score(self, vector: Column) -> Column:
        """2^(-E[path]/c(sample)) in [0, 1]; higher is more unusual."""
        trees = [t for _, t in self.nodes.groupby("tree", sort=True)]
        packed = [
            (t["feature"].to_numpy(), t["split"].to_numpy(), t["left"].to_numpy(),
             t["right"].to_numpy(), t["size"].to_numpy())
            for t in trees
        ]
        usual = float(np.mean([mean_path(int(p[4][0])) for p in packed])) or 1.0

        @F.pandas_udf("double")
        def isolate(vectors: pd.Series) -> pd.Series:
            if len(vectors) == 0:
                return pd.Series([], dtype="float64")
            x = np.stack(vectors.to_numpy())
            depth = np.zeros(len(x))
            for tree in packed:
                depth += _path_lengths(x, *tree)
            return pd.Series(np.power(2.0, -(depth / len(packed)) / usual))

        return isolate(vector)


def mean_path(n: int) -> float:
    """Average path length of an unsuccessful search in a tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _path_lengths(x, feature, split, left, right, size):
    at = np.zeros(len(x), dtype=np.int64)
    depth = np.zeros(len(x))
    moving = np.flatnonzero(feature[at] >= 0)
    while len(moving):
        here = at[moving]
        low = x[moving, feature[here]] < split[here]
        at[moving] = np.where(low, left[here], right[here])
        depth[moving] += 1
        moving = moving[feature[at[moving]] >= 0]
    rest = np.array([mean_path(int(n)) for n in size])
    return depth + rest[at]


def sample_for_trees(
    df: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 0,
    keys: Sequence[str] = WINDOW, rows: int | None = None,
) -> DataFrame:
    """`tree` and `scaled`: a hash-chosen sample per tree, the same on every run.

    Every tree draws from all rows by a hash of its own, twice its sample on average, and takes
    the `sample` rows (a parameter of the model) that come first; trees may share rows. The share
    to draw follows from `rows`, which is counted if not given.
    """
    count = df.count() if rows is None else rows
    share = min(1.0, 2.0 * sample / max(count, 1))
    mark = lambda *salt: F.pmod(F.xxhash64(*salt, *keys), F.lit(_SPACE))
    drawn = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: mark(F.lit(seed), tree) < int(share * _SPACE)
    )
    offered = df.withColumn("tree", F.explode(drawn))
    order = Window.partitionBy("tree").orderBy(mark(F.lit(seed + 2), F.col("tree")), *keys)
    chosen = offered.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= sample)
    return chosen.select(F.col("tree").cast("int").alias("tree"), "rn", "scaled")


def fit_forest(
    df: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 0,
    keys: Sequence[str] = WINDOW,
) -> Forest:
    """A forest over the `scaled` vectors."""

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        x = np.stack(group.sort_values("rn")["scaled"].to_numpy())
        nodes = _grow(x, np.random.default_rng((seed, tree)))
        nodes.insert(0, "tree", tree)
        return nodes

    chosen = sample_for_trees(df, trees, sample, seed, keys)
    grown = chosen.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    return Forest(_ordered(grown.toPandas()))  # bounded: trees * (2 * sample - 1) rows


def _ordered(nodes: pd.DataFrame) -> pd.DataFrame:
    return nodes.sort_values(["tree", "node"]).reset_index(drop=True)


def _grow(x: np.ndarray, rng: np.random.Generator) -> pd.DataFrame:
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    rows: list[list] = []
    pending = [(np.arange(len(x)), 0, None, None)]
    while pending:
        members, depth, parent, side = pending.pop()
        node = len(rows)
        if parent is not None:
            rows[parent][3 if side == "left" else 4] = node
        rows.append([node, -1, 0.0, -1, -1, len(members)])
        low, high = x[members].min(axis=0), x[members].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or len(usable) == 0:
            continue
        feature = int(rng.choice(usable))
        split = float(rng.uniform(low[feature], high[feature]))
        below = x[members, feature] < split
        rows[node][1], rows[node][2] = feature, split
        pending.append((members[~below], depth + 1, node, "right"))
        pending.append((members[below], depth + 1, node, "left"))
    return pd.DataFrame(rows, columns=["node", "feature", "split", "left", "right", "size"])

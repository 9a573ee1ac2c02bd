"""Vectors for the models: alignment, scaling, sequences, splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.ordered import running_totals
from tidegauge.functions.text import stable_share
from tidegauge.operators.windows import FLOW, WINDOW

METADATA = {*WINDOW, "window_key", "extracted_at", "_extracted_at", "feature_protocol"}
SEQUENCE_LENGTH = 10
SERIES = [*FLOW, "window_size"]


def feature_names(df: DataFrame) -> list[str]:
    """Numeric columns that are not metadata, sorted."""
    return sorted(
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType)
        and f.name not in METADATA
        and not f.name.startswith("_")
    )


def to_ml_input(df: DataFrame, keys: Sequence[str] = WINDOW) -> DataFrame:
    """Keys and the numeric features in sorted order."""
    return df.select(*keys, *[F.col(n) for n in feature_names(df)])


def _value(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0.0)
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def align_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """`features`: the values in the order of the fitted names, 0 where one is missing."""
    return df.withColumn("features", F.array(*[_value(df, n) for n in names]))


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per feature; a zero deviation counts as 1."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    def stats(self) -> dict[str, tuple[float, float]]:
        return {n: (m, s) for n, m, s in zip(self.names, self.means, self.stds)}


def scaler_stats(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """`name, mean, std` of every feature, from one pass of partial aggregates."""
    names = list(names or feature_names(df))
    wide = df.agg(*[
        F.struct(
            F.avg(_value(df, n)).alias("mean"), F.stddev_pop(_value(df, n)).alias("std")
        ).alias(n)
        for n in names
    ])
    rows = F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n)["mean"].alias("mean"), F.col(n)["std"].alias("std"))
        for n in names
    ])
    flat = wide.select(F.explode(rows).alias("r")).select("r.name", "r.mean", "r.std")
    # a deviation that is rounding noise against its mean is none
    noise = F.col("std") <= 1e-12 * F.greatest(F.lit(1.0), F.abs("mean"))
    return flat.withColumn("std", F.when(noise, 1.0).otherwise(F.col("std")))


def fit_scaler(df: DataFrame, names: Sequence[str] | None = None) -> Scaler:
    rows = {r["name"]: r for r in scaler_stats(df, names).collect()}  # one row per feature
    order = list(names or feature_names(df))
    return Scaler(
        tuple(order),
        tuple(float(rows[n]["mean"] or 0.0) for n in order),
        tuple(float(rows[n]["std"] if rows[n]["std"] is not None else 1.0) for n in order),
    )


def scale(df: DataFrame, scaler: Scaler | None, clip: float | None = None) -> DataFrame:
    """`scaled`: (x - mean)/std as an array; `clip` bounds it on both sides."""
    if scaler is None:
        raise RuntimeError("the scaler is not fitted")
    parts = []
    for name, mean, std in zip(scaler.names, scaler.means, scaler.stds):
        z = (_value(df, name) - mean) / std
        parts.append(z if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))
    return df.withColumn("scaled", F.array(*parts))


def inverse_scale(df: DataFrame, scaler: Scaler | None) -> DataFrame:
    """`restored`: the scaled array back in the original units."""
    if scaler is None:
        raise RuntimeError("the scaler is not fitted")
    parts = [
        F.col("scaled")[i] * std + mean for i, (mean, std) in enumerate(zip(scaler.means, scaler.stds))
    ]
    return df.withColumn("restored", F.array(*parts))


def save_scaler(spark: SparkSession, scaler: Scaler, path: str) -> None:
    rows = [(i, n, m, s) for i, (n, m, s) in enumerate(zip(scaler.names, scaler.means, scaler.stds))]
    frame = spark.createDataFrame(rows, "position int, name string, mean double, std double")
    frame.coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> Scaler:
    rows = spark.read.parquet(path).orderBy("position").collect()  # one row per feature
    return Scaler(
        tuple(r["name"] for r in rows), tuple(r["mean"] for r in rows), tuple(r["std"] for r in rows)
    )


def _series(mix_sizes: bool) -> list[str]:
    return FLOW if mix_sizes else SERIES


def _order(mix_sizes: bool) -> list[str]:
    return ["window_start", "window_size"] if mix_sizes else ["window_start"]


def _padded(sequence: Column, length: int) -> Column:
    zeros = F.transform(sequence[0], lambda _: F.lit(0.0))
    missing = F.greatest(F.lit(length) - F.size(sequence), F.lit(0))
    return F.concat(F.array_repeat(zeros, missing), sequence)


def rolling_sequences(
    df: DataFrame, length: int = SEQUENCE_LENGTH, pad: bool = True, mix_sizes: bool = False,
    idle_s: int | None = None,
) -> DataFrame:
    """`sequence`: the last vectors of the flow up to this window, zeros on the left if few.

    One vector per flow, size and window goes in, so a flow has as many rows as windows,
    whatever its traffic. `mix_sizes` puts all window sizes of a flow into one sequence. A flow
    that was silent for more than `idle_s` starts anew.
    """
    series, rows = _series(mix_sizes), df
    if idle_s is not None:
        run = "run__"
        along = Window.partitionBy(*series).orderBy(*_order(mix_sizes))
        silent = F.col("window_start") - F.lag("window_start").over(along) > idle_s
        rows = df.withColumn(run, F.coalesce(silent, F.lit(False)).cast("int"))
        rows = rows.withColumn(run, F.sum(run).over(along))
        series = [*series, run]
    back = Window.partitionBy(*series).orderBy(*_order(mix_sizes)).rowsBetween(-(length - 1), Window.currentRow)
    rows = rows.withColumn("sequence", F.collect_list("scaled").over(back))
    if idle_s is not None:
        rows = rows.drop(run)
    if pad:
        return rows.withColumn("sequence", _padded(F.col("sequence"), length))
    return rows.filter(F.size("sequence") == length)


def training_sequences(
    df: DataFrame, length: int = SEQUENCE_LENGTH, stride: int = 1, mix_sizes: bool = False
) -> DataFrame:
    """Overlapping sequences in time order; a shorter series gives one padded sequence."""
    series = Window.partitionBy(*_series(mix_sizes))
    rows = rolling_sequences(df, length, True, mix_sizes)
    rows = rows.withColumn("position", F.row_number().over(series.orderBy(*_order(mix_sizes))))
    rows = rows.withColumn("vectors", F.count(F.lit(1)).over(series))
    full = (F.col("position") >= length) & ((F.col("position") - length) % stride == 0)
    short = (F.col("vectors") < length) & (F.col("position") == F.col("vectors"))
    return rows.filter(full | short)


def sequence_stats(
    df: DataFrame, length: int = SEQUENCE_LENGTH, mix_sizes: bool = False
) -> DataFrame:
    """Number of series, how many can fill a sequence, and the mean buffer length."""
    held = df.groupBy(*_series(mix_sizes)).agg(F.count(F.lit(1)).alias("vectors"))
    return held.agg(
        F.count(F.lit(1)).alias("total_connections"),
        F.count_if(F.col("vectors") >= length).alias("ready_sequences"),
        F.coalesce(F.avg(F.least(F.col("vectors"), F.lit(length))), F.lit(0.0)).alias(
            "avg_buffer_length"
        ),
        F.lit(length).alias("sequence_length"),
    )


def prune_short(df: DataFrame, min_vectors: int, mix_sizes: bool = False) -> DataFrame:
    """Vectors of the series that have enough of them."""
    series = _series(mix_sizes)
    enough = df.groupBy(*series).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_vectors)
    return df.join(enough.select(*series), series, "left_semi")


def random_split(
    df: DataFrame, validation: float = 0.2, seed: int = 0, keys: Sequence[str] = WINDOW
) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by a hash of their key: stable under re-runs and reordering."""
    mark = stable_share(seed, *keys) < validation
    return df.filter(~mark), df.filter(mark)


def temporal_split(
    df: DataFrame, shares: tuple[float, float] = (0.7, 0.9), time: str = "window_start",
    ties: Sequence[str] = WINDOW,
) -> DataFrame:
    """`part`: train, validation or test by rank in time, cut at int(n * share).

    The cut moments come from running counts per distinct time, summed up in ranges of time; only the rows of the two cut
    moments themselves are ranked among each other.
    """
    counts = df.groupBy(time).agg(F.count(F.lit(1)).alias("n"))
    ordered = running_totals(counts, time, ["n"]).withColumnRenamed("running_n", "upto")
    marks = []
    for share in shares:
        wanted = F.floor(F.col("total_n") * share)
        marks.append(
            F.when((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted),
                   wanted - (F.col("upto") - F.col("n")))
        )
    edges = ordered.select(time, marks[0].alias("first"), marks[1].alias("second"))
    edges = edges.filter(F.col("first").isNotNull() | F.col("second").isNotNull())
    bounds = [(r[time], r["first"], r["second"]) for r in edges.collect()]  # at most two rows
    train_to = next(((t, a) for t, a, _ in bounds if a is not None), (None, 0))
    validation_to = next(((t, b) for t, _, b in bounds if b is not None), (None, 0))

    at_edge = F.col(time).isin([t for t, _, _ in bounds]) if bounds else F.lit(False)
    ranked = df.filter(at_edge).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(time).orderBy(*ties))
    )
    rows = df.filter(~at_edge).withColumn("_rank", F.lit(0)).unionByName(ranked)

    def inside(edge: tuple) -> Column:
        moment, take = edge
        if moment is None:
            return F.lit(False)
        return (F.col(time) < moment) | ((F.col(time) == moment) & (F.col("_rank") <= take))

    part = F.when(inside(train_to), "train").when(inside(validation_to), "validation").otherwise("test")
    return rows.withColumn("part", part).drop("_rank")

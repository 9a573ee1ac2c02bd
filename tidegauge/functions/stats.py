"""Small statistics built from ordinary columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: the constant inside the logarithm of every entropy feature
ENTROPY_EPSILON = 1e-10


def entropy_of_counts(counts: Column, total: Column) -> Column:
    """-sum p*log2(p + eps) over an array of value counts; 0 when there are none."""
    share = lambda c: c / total
    summed = F.aggregate(
        counts,
        F.lit(0.0),
        lambda acc, c: acc + share(c) * F.log2(share(c) + ENTROPY_EPSILON),
    )
    return F.when(total > 0, -summed).otherwise(0.0)


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of several one-row frames in one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def or_zero_double(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def clamp01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))

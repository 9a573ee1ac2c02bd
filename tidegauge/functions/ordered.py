"""Ordered computations that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES = 64


def running_totals(
    df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), pieces: int = PIECES
) -> DataFrame:
    """Inclusive running sums along `order`, as `running_<name>`, beside the group's sum, `total_<name>`.

    Each group is cut into ranges of about equal size by approximate quantiles. Running sums are
    built inside the ranges; the sums of the ranges before are added. The result does not depend
    on where the cuts fall. `by` names few groups (features, models), `order` has no ties.
    """
    by = list(by)
    shares = [i / pieces for i in range(1, pieces)]
    cuts = df.groupBy(*by).agg(F.percentile_approx(order, shares, 1000).alias("_cuts"))
    if by:
        cut = _matched(df, cuts, by)
        bounds = F.col("_cuts")
    else:
        found = cuts.first()[0] or []  # at most `pieces` numbers
        cut = df
        bounds = F.array(*[F.lit(c) for c in found]) if found else F.array().cast("array<double>")
    cut = cut.withColumn("_piece", F.size(F.filter(bounds, lambda c: c < F.col(order))))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "_piece").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    offsets = totals.select(
        *by, "_piece", *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(Window.partitionBy(*by)).alias(f"total_{s}") for s in sums],
    )
    inside = (
        Window.partitionBy(*by, "_piece")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = _matched(cut, offsets, [*by, "_piece"])
    for s in sums:
        summed = summed.withColumn(f"running_{s}", F.sum(s).over(inside) + F.col(f"_off_{s}"))
    return summed.drop("_piece", "_cuts", *[f"_off_{s}" for s in sums])


def _matched(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join by key names in which NULL equals NULL."""
    named = facts.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return rows.join(named, same).drop(*[f"_of_{k}" for k in keys])


def exact_quantiles(
    df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Per group the quantiles `shares` names, interpolated between neighbours, and `samples`.

    Ranks come from running counts of the distinct values, so neither many rows nor many distinct
    values of a group meet in one task. NULL is no value; a group without values has no row.
    """
    by = list(by)
    levels = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = running_totals(levels, "_value", ["n"], by)
    at = lambda place: F.min(F.when(F.col("running_n") > place, F.col("_value")))
    place = {name: share * (F.col("total_n") - 1) for name, share in shares.items()}
    found = ranked.groupBy(*by).agg(
        F.max("total_n").alias("total_n"),
        *[at(F.floor(p)).alias(f"_low_{name}") for name, p in place.items()],
        *[at(F.ceil(p)).alias(f"_high_{name}") for name, p in place.items()],
    )
    between = {
        name: F.col(f"_low_{name}") + (p - F.floor(p)) * (F.col(f"_high_{name}") - F.col(f"_low_{name}"))
        for name, p in place.items()
    }
    return found.select(*by, *[c.alias(name) for name, c in between.items()], F.col("total_n").alias("samples"))


def forward_fill(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], order: str, span: int
) -> DataFrame:
    """Missing values take the last known one of their group along the numeric `order`.

    Works per group and span of `order`; what a span starts with comes from one summary row per
    span, so a long series is spread over its spans. Rows without a place in the order stay as
    they are.
    """
    by = list(by)
    placed = F.col(order).isNotNull()
    cut = df.filter(placed).withColumn("_span", F.floor(F.col(order) / span))
    inside = (
        Window.partitionBy(*by, "_span")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last_known = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_last_{c}") for c in columns
    ]
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*by, "_span").agg(*last_known).select(
        *by, "_span", *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns]
    )
    filled = _matched(cut, carried, [*by, "_span"])
    for c in columns:
        own = F.last(c, ignorenulls=True).over(inside)
        filled = filled.withColumn(f"_fill_{c}", F.coalesce(own, F.col(f"_carry_{c}")))
    others = [c for c in df.columns if c not in columns]
    rest = df.filter(~placed).select(*others, *columns)
    return filled.select(*others, *[F.col(f"_fill_{c}").alias(c) for c in columns]).unionByName(rest)


def order_breaks(df: DataFrame, value: str, by: Sequence[str], order: str, span: int) -> DataFrame:
    """Per group, how often `value` is smaller than in the row before along `order`."""
    by = list(by)
    cut = df.filter(F.col(value).isNotNull()).withColumn("_span", F.floor(F.col(order) / span))
    inside = Window.partitionBy(*by, "_span").orderBy(order)
    inner = cut.withColumn("_down", (F.col(value) < F.lag(value).over(inside)).cast("int")).groupBy(
        *by
    ).agg(F.coalesce(F.sum("_down"), F.lit(0)).alias("_inner"))
    edges = cut.groupBy(*by, "_span").agg(
        F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last")
    )
    along = Window.partitionBy(*by).orderBy("_span")
    crossing = edges.withColumn(
        "_down", (F.col("_first") < F.lag("_last").over(along)).cast("int")
    ).groupBy(*by).agg(F.coalesce(F.sum("_down"), F.lit(0)).alias("_cross"))
    total: Column = F.col("_inner") + F.col("_cross")
    return inner.join(crossing, by).select(*by, total.alias("order_breaks"))

"""Partial states that add up: taken once per pane, merged upward to windows of any size.

A pane is a time span that all window sizes are multiples of. Aggregates over messages are computed per flow and pane only;
windows merge the few rows of their panes. Sums of squares are exact decimals, so deviations lose nothing on the way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.windows import FLOW, WINDOW, floor_to

PANE = [*FLOW, "pane_start"]


def pane_seconds(sizes: Sequence[int]) -> int:
    """The longest span that divides all sizes; the smallest size, where that divides the others."""
    return math.gcd(*[int(s) for s in sizes])


@dataclass(frozen=True)
class Measure:
    """An aggregate in parts: each part as an aggregate over messages, how parts merge, and the value made of them."""

    parts: dict[str, tuple[Column, Callable[[Column], Column]]]
    value: Callable[[dict[str, Column]], Column]

    def over_messages(self) -> Column:
        """The whole aggregate, without panes."""
        return self.value({name: part for name, (part, _) in self.parts.items()})


def _only(part: Column, merge: Callable[[Column], Column]) -> Measure:
    return Measure({"v": (part, merge)}, lambda p: p["v"])


def counted(condition: Column) -> Measure:
    return _only(F.count_if(condition), F.sum)


def present(column: Column | str) -> Measure:
    return _only(F.count(column), F.sum)


def summed(column: Column | str) -> Measure:
    return _only(F.sum(column), F.sum)


def smallest(column: Column | str) -> Measure:
    return _only(F.min(column), F.min)


def largest(column: Column | str) -> Measure:
    return _only(F.max(column), F.max)


def _square(column: Column | str) -> Column:
    whole = (F.col(column) if isinstance(column, str) else column).cast("decimal(19,0)")
    return whole * whole


def mean(column: Column | str) -> Measure:
    """Of whole numbers."""
    return Measure({"n": (F.count(column), F.sum), "s": (F.sum(column), F.sum)}, lambda p: p["s"] / p["n"])


def deviation(n: Column, total: Column, squares: Column) -> Column:
    """Population standard deviation from a count, a sum and a sum of squares; exact up to the root."""
    wide = lambda c: c.cast("decimal(38,0)")
    exact = F.try_subtract(F.try_multiply(wide(n), wide(squares)), F.try_multiply(wide(total), wide(total)))
    rough = n.cast("double") * squares.cast("double") - total.cast("double") * total.cast("double")
    return F.sqrt(F.greatest(F.coalesce(exact.cast("double"), rough), F.lit(0.0))) / n


def spread(column: Column | str) -> Measure:
    """Population standard deviation of whole numbers; null without any."""
    return Measure(
        {"n": (F.count(column), F.sum), "s": (F.sum(column), F.sum), "q": (F.sum(_square(column)), F.sum)},
        lambda p: F.when(p["n"] > 0, deviation(p["n"], p["s"], p["q"])),
    )


def in_panes(messages: DataFrame, sizes: Sequence[int]) -> DataFrame:
    return messages.withColumn("pane_start", floor_to(F.col("ts_us"), pane_seconds(sizes)))


def _upward(panes: DataFrame, sizes: Sequence[int], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of panes as rows of all windows, with the columns of WINDOW first.

    Each size merges the rows of the largest smaller size that divides it, so upper sizes read rows merged already. Panes that
    are windows themselves pass as they are.
    """
    levels = {pane_seconds(sizes): panes}
    out = None
    for size in sorted(set(map(int, sizes))):
        if size not in levels:
            below = levels[max(s for s in levels if size % s == 0)]
            start = (F.col("pane_start") - F.pmod(F.col("pane_start"), F.lit(size))).cast("bigint")
            levels[size] = merge(below.withColumn("pane_start", start))
        rest = [c for c in panes.columns if c not in PANE]
        rows = levels[size].select(
            *FLOW, F.lit(size).alias("window_size"), F.col("pane_start").alias("window_start"), *rest
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def measured(messages: DataFrame, measures: dict[str, Measure], sizes: Sequence[int]) -> DataFrame:
    """One row per window with the value of every measure."""
    named = {(name, part): f"{name}__{part}" for name, m in measures.items() for part in m.parts}
    panes = in_panes(messages, sizes).groupBy(*PANE).agg(
        *[measures[name].parts[part][0].alias(column) for (name, part), column in named.items()]
    )
    merging = [measures[name].parts[part][1](F.col(column)).alias(column) for (name, part), column in named.items()]
    merged = _upward(panes, sizes, lambda rows: rows.groupBy(*PANE).agg(*merging))
    values = [
        m.value({part: F.col(named[name, part]) for part in m.parts}).alias(name) for name, m in measures.items()
    ]
    return merged.select(*WINDOW, *values)


def merged_counts(panes: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Value counts of panes (`PANE, kind, value, count, first_seen`) as those of all windows."""
    merging = [F.sum("count").alias("count"), F.min("first_seen").alias("first_seen")]
    return _upward(panes, sizes, lambda rows: rows.groupBy(*PANE, "kind", "value").agg(*merging))

"""Timed suppression of repeated alerts.

The first alert of a key passes and locks the key for a while; alerts inside the lock are
suppressed and do not prolong it. Which alert passes depends on the one before it, so a key is a
chain. The chain is cut into blocks of time: a block needs nothing of the past but the moment the
lock ends, hence it can be summed up as a small table "lock end on entry -> lock end on exit".
Neighbouring tables are composed to the table of a larger span, and those once more, so that no row
gathers more than SPAN of them; then the entries come back down the same levels, and every block is
replayed from its own. All work on single seconds is spread over blocks, and equal seconds of a key
are merged before anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_S = 60
BLOCK_LOCKS = 10  # block length in lock lengths
SPAN = 128  # tables composed to one
LEVELS = 2  # a key gathers one table per SPAN**LEVELS blocks: at a lock of 60 s, one in 114 days
_NEVER = 1 << 62


def suppress_duplicates(
    alerts: DataFrame,
    ttl_s: int = TTL_S,
    key: str = "dedup_key",
    time: str = "detected_s",
    order: str = "anomaly_id",
    releases: DataFrame | None = None,
) -> DataFrame:
    """The alerts with `suppressed`.

    `releases(key, released_s)` free a key before its time, as an acknowledgement does.
    """
    passed = passing_seconds(alerts, ttl_s, key, time, order, releases)
    joined = alerts.join(passed, [key, time], "left")
    passes = F.coalesce(F.col(order) == F.col("first_order"), F.lit(False))
    return joined.withColumn("suppressed", ~passes).drop("first_order")


def passing_seconds(
    alerts: DataFrame,
    ttl_s: int = TTL_S,
    key: str = "dedup_key",
    time: str = "detected_s",
    order: str = "anomaly_id",
    releases: DataFrame | None = None,
) -> DataFrame:
    """`key, time, first_order` of the alerts that pass."""
    block_s = BLOCK_LOCKS * ttl_s
    seconds = (
        alerts.groupBy(key, time).agg(F.min(order).alias("first_order"))
        .withColumn("block", F.floor(F.col(time) / block_s))
    )
    blocks = (
        _with_lock_end(seconds, ttl_s, block_s, key, time, releases)
        .groupBy(key, "block")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(F.col(time).alias("at"), F.col("lock_end"), F.col("first_order"))
                )
            ).alias("events")
        )
    )
    along = Window.partitionBy(key).orderBy("block")
    fresh = F.coalesce(F.lag("block").over(along) != F.col("block") - 1, F.lit(True))
    blocks = blocks.withColumn("run", F.sum(fresh.cast("int")).over(along))
    blocks = blocks.withColumn("run_length", F.count(F.lit(1)).over(Window.partitionBy(key, "run")))

    # a block without a neighbour before it starts unlocked: no lock is as long as a block
    entries = _chain(blocks.filter(F.col("run_length") > 1), key, ttl_s, block_s)
    resolved = blocks.join(entries, [key, "block"], "left")
    kept = resolved.select(key, F.explode(_replay(F.col("entry"))).alias("e"))
    return kept.select(key, F.col("e.at").alias(time), F.col("e.first_order").alias("first_order"))


def _with_lock_end(
    seconds: DataFrame, ttl_s: int, block_s: int, key: str, time: str, releases: DataFrame | None
) -> DataFrame:
    """When the lock set in a second ends: after `ttl_s`, or at the first release from that second on.

    Only releases within the lock length matter, so each is looked for in its own block and, if it
    is early in there, from the block before.
    """
    end = F.col(time) + ttl_s
    if releases is None:
        return seconds.withColumn("lock_end", end)
    near = F.array_distinct(F.array(*[F.floor((F.col("released_s") - n) / block_s) for n in (0, ttl_s)]))
    freeing = releases.select(key, F.col("released_s").alias(time), "released_s", F.explode(near).alias("block"))
    both = seconds.unionByName(freeing, allowMissingColumns=True)
    ahead = Window.partitionBy(key, "block").orderBy(time).rangeBetween(0, ttl_s)
    next_release = F.min("released_s").over(ahead)
    freed = F.when(next_release.isNotNull(), F.greatest(next_release, F.col(time) + 1))
    return (
        both.withColumn("lock_end", F.least(end, freed))
        .filter(F.col("released_s").isNull()).drop("released_s")
    )


def _lock_after(start: Column) -> Column:
    """Lock end after all events of the block when the first event at or after `start` passes."""
    return F.aggregate(
        "events", start, lambda lock, e: F.when(e["at"] >= lock, e["lock_end"]).otherwise(lock)
    )


def _replay(entry: Column) -> Column:
    """The events of the block that pass, given the lock end on entry."""
    start = F.struct(
        F.coalesce(entry, F.lit(-(1 << 62))).alias("lock"),
        F.slice("events", 1, 0).alias("kept"),
    )
    return F.aggregate(
        "events",
        start,
        lambda state, e: F.when(
            e["at"] >= state["lock"],
            F.struct(
                e["lock_end"].alias("lock"), F.concat(state["kept"], F.array(e)).alias("kept")
            ),
        ).otherwise(state),
        lambda state: state["kept"],
    )


def _chain(chained: DataFrame, key: str, ttl_s: int, block_s: int) -> DataFrame:
    """Lock end on entry of every block of a run: `key, block, entry`."""
    reach = F.col("block") * block_s + ttl_s  # an earlier lock ends before this
    early = F.filter("events", lambda e: e["at"] < reach)
    starts = F.slice("events", 1, F.size(early) + 1)
    steps = F.transform(
        starts, lambda e: F.struct(e["at"].alias("start"), _lock_after(e["at"]).alias("exit"))
    )
    tables = chained.select(key, "run", "block", steps.alias("steps"))
    levels = []
    for _ in range(LEVELS):
        spans = _gathered(tables.withColumn("span", F.floor(F.col("block") / SPAN)), key, "run", "span")
        levels.append(spans)
        tables = spans.select(key, "run", F.col("span").alias("block"), _composed().alias("steps"))
    runs = _gathered(tables, key, "run")
    entries = runs.select(key, "run", F.explode(_entries(F.lit(None).cast("bigint"))).alias("e"))
    for spans in reversed(levels):
        entered = entries.select(key, "run", F.col("e.block").alias("span"), "e.entry")
        entries = spans.join(entered, [key, "run", "span"]).select(
            key, "run", F.explode(_entries(F.col("entry"))).alias("e")
        )
    return entries.select(key, "e.block", "e.entry")


def _gathered(tables: DataFrame, *place: str) -> DataFrame:
    table = F.struct("block", "steps")
    return tables.groupBy(*place).agg(F.array_sort(F.collect_list(table)).alias("tables"))


def _after(lock: Column, table: Column) -> Column:
    """Lock end on exit of a table; a lock beyond all its starts outlives it."""
    taken = F.filter(table["steps"], lambda s: lock.isNull() | (s["start"] >= lock))
    return F.coalesce(F.get(taken, F.lit(0))["exit"], lock)


def _composed() -> Column:
    """Steps of all `tables` as one: the starts of the first, and none of them, with the last exit."""
    later = F.slice("tables", 2, SPAN)
    through = lambda lock: F.aggregate(later, lock, _after)
    no_lock = F.lit(None).cast("bigint")
    first = F.transform(
        F.get("tables", F.lit(0))["steps"],
        lambda s: F.struct(s["start"].alias("start"), through(s["exit"]).alias("exit")),
    )
    # a lock beyond the starts ends before the next block, where it is as good as none
    beyond = F.struct(F.lit(_NEVER).alias("start"), through(no_lock).alias("exit"))
    return F.concat(first, F.array(beyond))


def _entries(entry: Column) -> Column:
    """The lock end on entry of each of `tables`."""
    no_entries = F.array().cast("array<struct<block:bigint,entry:bigint>>")
    start = F.struct(entry.alias("lock"), no_entries.alias("entries"))
    return F.aggregate("tables", start, _enter, lambda state: state["entries"])


def _enter(state: Column, table: Column) -> Column:
    return F.struct(
        _after(state["lock"], table).alias("lock"),
        F.concat(
            state["entries"],
            F.array(F.struct(table["block"].alias("block"), state["lock"].alias("entry"))),
        ).alias("entries"),
    )

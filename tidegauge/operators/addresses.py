"""Register addresses a flow has not used before, against bitmaps of those it has.

A baseline holds 32,768 addresses in 4 KB per flow, so baselines of periods are merged with `bitmap_or_agg` and stay small
whatever the traffic. Windows carry their distinct addresses only, and each is looked up as one bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import names
from tidegauge.operators.windows import DEFAULT_SIZES, FLOW, MICROS, WINDOW, assign_windows

BITS = 8 * 4096  # of a bitmap, as Spark's bitmap functions have them
MULTIPLE_WRITES = (15, 16)  # fixed values: function codes that write a run of addresses


def touched(messages: DataFrame, writes_only: bool = True) -> DataFrame:
    """Modbus messages once per address they touch, as `address`; a run counts whole, anything else one address."""
    code, start = F.col("function_code"), F.col("start_address").cast("bigint")
    rows = messages.filter((F.lower("protocol") == "modbus") & (start >= 0) & F.col("ts_us").isNotNull())
    if writes_only:
        rows = rows.filter(code.isin(names.MODBUS_WRITE))
    runs = code.isin(*MULTIPLE_WRITES) if writes_only else F.lit(True)
    many = F.when(runs, F.greatest(F.coalesce(F.col("quantity").cast("bigint"), F.lit(1)), F.lit(1))).otherwise(F.lit(1))
    return rows.select(*FLOW, "ts_us", F.explode(F.sequence(start, start + many - 1)).alias("address"))


def _bucket() -> Column:
    return F.floor(F.col("address") / BITS)


def address_baseline(messages: DataFrame, until_s: int, writes_only: bool = True) -> DataFrame:
    """`FLOW, bucket, known`: a bitmap of the addresses a flow touched before `until_s`."""
    early = touched(messages.filter(F.col("ts_us") < until_s * MICROS), writes_only)
    place = F.pmod(F.col("address"), F.lit(BITS)).cast("bigint")
    return early.groupBy(*FLOW, _bucket().alias("bucket")).agg(F.bitmap_construct_agg(place).alias("known"))


def merge_baselines(*baselines: DataFrame) -> DataFrame:
    """The baseline of several periods together."""
    rows = baselines[0]
    for more in baselines[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*FLOW, "bucket").agg(F.bitmap_or_agg("known").alias("known"))


def _is_known() -> Column:
    place = F.pmod(F.col("address"), F.lit(BITS))
    byte = F.conv(F.hex(F.substring("known", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.pow(F.lit(2), F.pmod(place, F.lit(8))).cast("int")) > 0, F.lit(False))


def new_addresses(
    messages: DataFrame, baseline: DataFrame, sizes: Sequence[int] = DEFAULT_SIZES, writes_only: bool = True,
    name: str = "new_write_addresses",
) -> DataFrame:
    """Windows with the number of distinct addresses their flow's baseline lacks; windows that touch none are absent.

    A flow the baseline does not know has only new addresses.
    """
    seen = assign_windows(touched(messages, writes_only), sizes).select(*WINDOW, "address").distinct()
    judged = seen.withColumn("bucket", _bucket()).join(baseline, [*FLOW, "bucket"], "left")
    return judged.groupBy(*WINDOW).agg(F.count_if(~_is_known()).alias(name))


def with_new_addresses(rows: DataFrame, found: DataFrame, name: str = "new_write_addresses") -> DataFrame:
    """Vectors with the count of new addresses, 0 where there are none."""
    return rows.join(found.select(*WINDOW, name), WINDOW, "left").withColumn(name, F.coalesce(name, F.lit(0)))

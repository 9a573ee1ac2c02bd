"""Text built from columns: keys, titles, ages and escapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_key(*parts: Column | str) -> Column:
    """Parts with a colon between them; an absent part leaves its place empty, so keys can't coincide over it."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def title_case(snake: Column) -> Column:
    """`timing_anomaly` -> `Timing Anomaly`."""
    return F.initcap(F.replace(snake, F.lit("_"), F.lit(" ")))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def three_decimals(value: Column) -> Column:
    return F.format_string("%.3f", value)


def relative_age(then_s: Column, as_of_s: Column | int) -> Column:
    """`42s ago`, `7m ago`, `3h ago`, `2d ago` from epoch seconds."""
    now = F.lit(as_of_s) if isinstance(as_of_s, int) else as_of_s
    age = now - then_s
    bucket = lambda width, unit: F.concat(
        F.floor(age / width).cast("string"), F.lit(unit + " ago")
    )
    return (
        F.when(age < 60, bucket(1, "s"))
        .when(age < 3600, bucket(60, "m"))
        .when(age < 86400, bucket(3600, "h"))
        .otherwise(bucket(86400, "d"))
    )


def escape_cef(value: Column) -> Column:
    """Backslash, equals sign and newline escaped for a CEF extension value."""
    slashed = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    equals = F.replace(slashed, F.lit("="), F.lit("\\="))
    return F.replace(equals, F.lit("\n"), F.lit("\\n"))


def cef_extension(pairs: Sequence[tuple[str, Column]]) -> Column:
    """`k=v` pairs in order, absent values left out."""
    parts = [F.concat(F.lit(f"{key}="), escape_cef(value.cast("string"))) for key, value in pairs]
    return F.concat_ws(" ", *parts)


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    """Value of a small fixed table; `default` where the key is not in it."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, default)


def stable_share(seed: int, *keys: str) -> Column:
    """A number in [0, 1) drawn from an MD5 digest of the seed and the keys: the same in every run, order and engine."""
    named = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("double") / (1 << 32)

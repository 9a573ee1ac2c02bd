"""Integers out of hex text, as Catalyst expressions.

Payloads stay the hex text they arrive as: two digits per byte, so a number is a slice of the
text and one base conversion. Offsets count bytes from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TO_END = 1 << 30


def decode_hex(text: Column) -> Column:
    """Lower-case hex text; NULL for an odd length or a foreign character."""
    return F.when((F.length(text) % 2 == 0) & F.unhex(text).isNotNull(), F.lower(text))


def take(data: Column, offset: int | Column, count: int | Column) -> Column:
    return F.substring(data, offset * 2 + 1, count * 2)


def rest(data: Column, offset: int | Column) -> Column:
    """Everything from `offset` on."""
    return F.substring(data, offset * 2 + 1, TO_END)


def size(data: Column) -> Column:
    return F.floor(F.length(data) / 2).cast("int")


def u8(data: Column, offset: int | Column) -> Column:
    return _number(take(data, offset, 1)).cast("int")


def u16be(data: Column, offset: int | Column) -> Column:
    return _number(take(data, offset, 2)).cast("int")


def u16le(data: Column, offset: int) -> Column:
    return _number(_reversed(data, offset, 2)).cast("int")


def u32le(data: Column, offset: int) -> Column:
    return _number(_reversed(data, offset, 4))


def flag(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask)) != 0


def utf8(data: Column) -> Column:
    """Text of the bytes, NULL where they are not valid UTF-8."""
    return F.try_validate_utf8(F.unhex(data).cast("string"))


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def _reversed(data: Column, offset: int, count: int) -> Column:
    return F.concat(*[take(data, offset + i, 1) for i in reversed(range(count))])

"""Modbus/TCP decoding in column steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.functions import bytes as by
from tidegauge.functions import names

HEADER = 8  # address header (7 bytes) plus the function code


def is_decodable(payload: Column) -> Column:
    return by.size(payload) >= HEADER


def steps(payload: Column) -> list[dict[str, Column]]:
    """Columns to add one step after the other; the last one is the decoded struct, NULL for a
    payload too short to hold a header. Steps keep shared slices in columns of their own."""
    raw_code, body = F.col("_mb_raw_code"), F.col("_mb_body")
    code, length = F.col("_mb_code"), F.col("_mb_length")
    exception = by.flag(raw_code, 0x80)
    shape = F.col("_mb_shape")
    return [
        {"_mb": F.when(is_decodable(payload), payload)},
        {"_mb_raw_code": by.u8(F.col("_mb"), 7), "_mb_body": by.rest(F.col("_mb"), HEADER)},
        {
            "_mb_code": raw_code.bitwiseAND(F.lit(0x7F)).cast("int"),
            "_mb_length": by.size(body),
        },
        {
            # four bytes after a register read count as a request, also when they are a response
            "_mb_shape": F.when(exception, "exception")
            .when(code.isin(1, 2), F.when(length >= 4, "request"))
            .when(
                code.isin(3, 4),
                F.when(length == 4, "request").when(length > 0, "response"),
            )
            .when(code.isin(5, 6), F.when(length >= 4, "single"))
            .when(code.isin(15, 16), F.when(length >= 5, "multiple"))
            .otherwise("other")
        },
        {"modbus": F.when(F.col("_mb").isNotNull(), _message(F.col("_mb"), body, code, shape, length))},
    ]


def _message(payload: Column, body: Column, code: Column, shape: Column, length: Column) -> Column:
    decoded = {
        "transaction_id": by.u16be(payload, 0),
        "protocol_id": by.u16be(payload, 2),
        "length": by.u16be(payload, 4),
        "unit_id": by.u8(payload, 6),
        "function_code": code,
        "function_name": names.modbus_function_name(code),
        "is_exception": F.coalesce(shape == "exception", F.lit(False)),
        "exception_code": F.when((shape == "exception") & (length > 0), by.u8(body, 0)),
        "start_address": F.when(shape.isin("request", "single", "multiple"), by.u16be(body, 0)),
        "quantity": F.when(shape.isin("request", "multiple"), by.u16be(body, 2)),
        "byte_count": F.when(shape == "response", by.u8(body, 0)).when(
            shape == "multiple", by.u8(body, 4)
        ),
        "values": F.when(shape == "response", _registers(body, 1, length))
        .when(shape == "single", F.array(by.u16be(body, 2)))
        .when(shape == "multiple", _registers(body, 5, length)),
        "coil_status": F.lit(None),
        "raw_data": F.when(shape == "other", body),
    }
    return F.struct(*[decoded[f.name].cast(f.dataType).alias(f.name) for f in schemas.MODBUS.fields])


def _registers(body: Column, offset: int, length: Column) -> Column:
    """Whole big-endian words from `offset`; an odd last byte is left out, no words is NULL."""
    words = F.floor((length - offset) / 2).cast("int")
    return F.when(
        words > 0,
        F.transform(
            F.sequence(F.lit(0), words - 1), lambda i: by.u16be(body, i * 2 + offset)
        ),
    )

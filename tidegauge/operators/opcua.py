"""OPC-UA binary transport decoding in column steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.functions import bytes as by
from tidegauge.functions import names
from tidegauge.functions.text import lookup

HEADER = 8
URL_LIMIT = 4096


def is_decodable(payload: Column) -> Column:
    return by.size(payload) >= HEADER


def steps(payload: Column) -> list[dict[str, Column]]:
    """Columns to add one step after the other; the last one is the decoded struct, NULL for a
    payload too short to hold a header."""
    message, tag, body = F.col("_ua"), F.col("_ua_tag"), F.col("_ua_body")
    length = F.col("_ua_length")
    return [
        {"_ua": F.when(is_decodable(payload), payload)},
        {"_ua_tag": by.utf8(by.take(message, 0, 3)), "_ua_body": by.rest(message, HEADER)},
        {"_ua_length": by.size(body)},
        {
            "_ua_shape": F.when(tag.isin("HEL", "ACK") & (length >= 20), "limits")
            .when(tag.isin("OPN", "CLO") & (length >= 4), "channel")
            .when((tag == "MSG") & (length >= 16), "message")
            .when(tag == "ERR", "error"),
            "_ua_url_length": F.when((tag == "HEL") & (length >= 24), by.u32le(body, 20)),
        },
        {"opcua": F.when(message.isNotNull(), _message(message, tag, body, length))},
    ]


def _message(message: Column, tag: Column, body: Column, length: Column) -> Column:
    shape, url_length = F.col("_ua_shape"), F.col("_ua_url_length")
    url_fits = (url_length > 0) & (url_length < URL_LIMIT) & (length - 24 >= url_length)
    unknown_type = F.concat(F.lit('Unknown ("'), F.coalesce(tag, F.lit("???")), F.lit('")'))
    limits = lambda offset: F.when(shape == "limits", by.u32le(body, offset))
    numbers = lambda offset: F.when(shape == "message", by.u32le(body, offset))
    decoded = {
        "message_type": lookup(names.OPCUA_TYPES, tag, unknown_type),
        "message_type_code": F.array(*[by.u8(message, i) for i in range(3)]),
        "is_final": by.u8(message, 3) == ord("F"),
        "message_size": by.u32le(message, 4),
        "secure_channel_id": F.when(shape.isin("channel", "message"), by.u32le(body, 0)),
        "protocol_version": limits(0),
        "receive_buffer_size": limits(4),
        "send_buffer_size": limits(8),
        "max_message_size": limits(12),
        "max_chunk_count": limits(16),
        "endpoint_url": F.when(url_fits, by.utf8(by.take(body, 24, url_length.cast("int")))),
        "security_token_id": numbers(4),
        "sequence_number": numbers(8),
        "request_id": numbers(12),
        "service_type": F.when(shape == "error", "Error").when(
            shape == "channel",
            F.when(tag == "OPN", "OpenSecureChannel").otherwise("CloseSecureChannel"),
        ),
        # what no other field covers; a message needs four bytes of it
        "raw_payload": F.when(shape.isNull() | (shape == "error"), body)
        .when((shape == "channel") & (length > 4), by.rest(body, 4))
        .when((shape == "message") & (length >= 20), by.rest(body, 16)),
    }
    return F.struct(*[decoded[f.name].cast(f.dataType).alias(f.name) for f in schemas.OPCUA.fields])

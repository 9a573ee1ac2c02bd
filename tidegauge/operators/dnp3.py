"""DNP3 decoding in column steps: link, transport and application layer, first object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions import bytes as by
from tidegauge.functions import names

HEADER = 10  # link header with its checksum
START = "6405"  # 0x0564 little-endian, as the two bytes arrive
OBJECT_DATA_LIMIT = 100


def is_decodable(payload: Column) -> Column:
    return (by.size(payload) >= HEADER) & payload.startswith(START)


def steps(payload: Column) -> list[dict[str, Column]]:
    """Columns to add one step after the other; the last one is the decoded struct, NULL for a
    short payload or foreign start bytes."""
    frame, control, rest = F.col("_dn"), F.col("_dn_control"), F.col("_dn_rest")
    code, app, area = F.col("_dn_code"), F.col("_dn_app"), F.col("_dn_area")
    from_master = by.flag(control, 0x80)
    user_data = (by.size(rest) > 2) & code.isin(3, 4)
    indicated = ~from_master & (by.size(app) >= 4)
    return [
        {"_dn": F.when(is_decodable(payload), payload)},
        {"_dn_control": by.u8(frame, 3), "_dn_rest": by.rest(frame, HEADER)},
        {"_dn_code": control.bitwiseAND(F.lit(0x0F)).cast("int")},
        {
            "_dn_transport": F.when(user_data, by.u8(rest, 0)),
            "_dn_app": F.when(user_data & (by.size(rest) > 3), by.rest(rest, 1)),
        },
        {"_dn_area": F.when(indicated, by.rest(app, 4)).otherwise(by.rest(app, 2))},
        {
            "_dn_qualifier": by.u8(area, 2).bitwiseAND(F.lit(0x0F)).cast("int"),
            "_dn_group": by.u8(area, 0),
            "_dn_variation": by.u8(area, 1),
        },
        {"dnp3": F.when(frame.isNotNull(), _frame(frame, control, code, rest, app, area, indicated))},
    ]


def _frame(
    frame: Column, control: Column, code: Column, rest: Column, app: Column, area: Column,
    indicated: Column,
) -> Column:
    transport = F.col("_dn_transport")
    return F.struct(
        F.lit(0x0564).alias("start_bytes"),
        by.u8(frame, 2).alias("length"),
        control.alias("control"),
        by.u16le(frame, 4).alias("destination"),
        by.u16le(frame, 6).alias("source"),
        by.flag(control, 0x80).alias("is_master"),
        by.flag(control, 0x20).alias("frame_count_bit"),
        by.flag(control, 0x10).alias("frame_count_valid"),
        code.alias("function_code"),
        names.dnp3_link_name(code).alias("function_name"),
        F.when(
            transport.isNotNull(),
            F.struct(
                by.flag(transport, 0x80).alias("final_fragment"),
                by.flag(transport, 0x40).alias("first_fragment"),
                transport.bitwiseAND(F.lit(0x3F)).cast("int").alias("sequence"),
            ),
        ).alias("transport_header"),
        F.when(app.isNotNull(), _application(app, area, indicated)).alias("application"),
        F.when(transport.isNull() & (by.size(rest) > 0), rest).alias("raw_payload"),
    )


def _application(app: Column, area: Column, indicated: Column) -> Column:
    control, code = by.u8(app, 0), by.u8(app, 1)
    return F.struct(
        F.struct(
            by.flag(control, 0x80).alias("final_fragment"),
            by.flag(control, 0x40).alias("first_fragment"),
            by.flag(control, 0x20).alias("confirm_expected"),
            by.flag(control, 0x10).alias("unsolicited"),
            control.bitwiseAND(F.lit(0x0F)).cast("int").alias("sequence"),
        ).alias("control"),
        code.alias("function_code"),
        names.dnp3_application_name(code).alias("function_name"),
        F.when(indicated, by.u16le(app, 2)).alias("internal_indications"),
        F.when(by.size(area) >= 3, F.array(_first_object(area))).alias("objects"),
    )


def _first_object(area: Column) -> Column:
    """The first object header only; a range that runs backwards has no count."""
    group, variation = F.col("_dn_group"), F.col("_dn_variation")
    length = by.size(area)
    ranged = F.col("_dn_qualifier").isin(0, 1) & (length >= 5)
    counted = F.col("_dn_qualifier").isin(7, 8) & (length > 3)
    span = by.u8(area, 4) - by.u8(area, 3) + 1
    data = (
        F.when(ranged, by.take(area, 5, OBJECT_DATA_LIMIT))
        .when(counted, by.take(area, 4, OBJECT_DATA_LIMIT))
        .otherwise(by.take(area, 3, OBJECT_DATA_LIMIT))
    )
    return F.struct(
        group.alias("group"),
        variation.alias("variation"),
        by.u8(area, 2).alias("qualifier"),
        names.dnp3_object_name(group, variation).alias("description"),
        F.when(ranged & (span > 0), span).when(counted, by.u8(area, 3)).alias("count"),
        F.nullif(data, F.lit("")).alias("data"),
    )

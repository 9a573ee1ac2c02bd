"""Packet selection and routing ahead of the decoders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import bytes as by
from tidegauge.functions import names

WATCHED_PORTS = tuple(names.PORT_PROTOCOL)
DECODED_PROTOCOLS = ("modbus", "dnp3", "opcua")

IPV4 = r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"
IPV6 = (
    r"^(?i)(([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}"
    r"|(?=.*::)(?!.*::.*::)(([0-9a-f]{1,4}:){0,6}|:):?((:?[0-9a-f]{1,4}){0,7})?)$"
)


def is_ip(address: Column) -> Column:
    return address.rlike(IPV4) | address.rlike(IPV6)


def filter_packets(df: DataFrame, ports: Sequence[int] = WATCHED_PORTS) -> DataFrame:
    """TCP/UDP packets with a payload that touch a watched port."""
    watched = list(ports)
    return df.filter(
        F.col("protocol").isin("tcp", "udp")
        & (F.col("payload_size") > 0)
        & (F.col("src_port").isin(watched) | F.col("dst_port").isin(watched))
    )


def label_protocol(df: DataFrame) -> DataFrame:
    """`ics_protocol` from the ports."""
    return df.withColumn("ics_protocol", names.ics_protocol(F.col("dst_port"), F.col("src_port")))


def flow_records(df: DataFrame, port: int = 502) -> DataFrame:
    """Flat flow rows for packets sent to one port; byte 8 of a long enough payload is the code."""
    payload = by.decode_hex(F.col("payload_hex"))
    return df.filter(F.col("dst_port") == port).select(
        "timestamp",
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        by.size(payload).alias("payload_len"),
        F.when(by.size(payload) >= 8, by.u8(payload, 7)).alias("function_code"),
    )

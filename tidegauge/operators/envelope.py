"""From packets to decoded messages, and from messages to the columns features are built on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import bytes as by
from tidegauge.functions import names
from tidegauge.operators import dnp3, modbus, opcua
from tidegauge.operators.packets import is_ip

ENVELOPE = ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port"]
CLOCK_SKEW_S = 300
DECODERS = {"modbus": modbus, "dnp3": dnp3, "opcua": opcua}

# canonical message columns and their types
FLAT_COLUMNS = {
    "src_ip": "string", "dst_ip": "string", "protocol": "string", "ts_us": "bigint",
    "has_time": "boolean", "msg_id": "bigint", "payload_size": "bigint", "src_port": "int", "dst_port": "int",
    "function_code": "int", "unit_id": "int", "start_address": "int", "quantity": "int",
    "is_exception": "boolean", "exception_code": "int", "values": "array<int>",
    "dnp3_code": "int", "dnp3_source": "int", "dnp3_destination": "int", "is_master": "boolean",
    "unsolicited": "boolean", "object_groups": "array<int>", "message_type": "string",
    "secure_channel_id": "bigint", "security_token_id": "bigint", "service_type": "string",
    "sequence_number": "bigint",
}


def decode_payload(df: DataFrame, protocol: str, payload: str = "payload") -> DataFrame:
    """Add the decoded struct of one protocol, for rows whose payload is not NULL."""
    return _apply_steps(df, [DECODERS[protocol].steps(F.col(payload))])


def decode_packets(df: DataFrame) -> DataFrame:
    """Every packet with its decoded body and, where it is dropped, the reason.

    A chain of projections over the packet table: no shuffle, no Python. The reason depends on the
    payload and the protocol alone, so a filter on it runs below the decoding.
    """
    protocol = F.lower("ics_protocol")
    staged = df.withColumn("payload", by.decode_hex(F.col("payload_hex")))
    of_protocol = lambda name: F.when(protocol == name, F.col("payload"))
    decoded = _apply_steps(
        staged, [decoder.steps(of_protocol(name)) for name, decoder in DECODERS.items()]
    )
    reason = F.when(F.col("payload").isNull(), "bad_hex").when(
        ~F.coalesce(protocol.isin(*DECODERS), F.lit(False)), "unknown_protocol"
    )
    for name, decoder in DECODERS.items():
        reason = reason.when(
            (protocol == name) & ~decoder.is_decodable(F.col("payload")), "undecodable"
        )
    return decoded.withColumn("reject_reason", reason)


def _apply_steps(df: DataFrame, plans: list[list[dict[str, Column]]]) -> DataFrame:
    kept = df.columns
    for level in range(max(len(plan) for plan in plans)):
        added = [plan[level] for plan in plans if level < len(plan)]
        df = df.withColumns({name: c for columns in added for name, c in columns.items()})
    results = [name for plan in plans for name in plan[-1]]
    return df.select(*kept, *results)


def route_by_protocol(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded packets, and the ones dropped with the reason."""
    decoded = decode_packets(df)
    kept = decoded.filter(F.col("reject_reason").isNull()).drop("reject_reason", "payload")
    dropped = decoded.filter(F.col("reject_reason").isNotNull()).drop(
        "modbus", "dnp3", "opcua", "payload"
    )
    return kept, dropped


def to_envelope(decoded: DataFrame, compat_zero_bytes: bool = False) -> DataFrame:
    """One wide row per message: envelope plus one nullable struct per protocol.

    `payload_size` is carried so that byte features are real; `compat_zero_bytes` drops it
    the way an envelope without that field does.
    """
    size = F.lit(None).cast("bigint") if compat_zero_bytes else F.col("payload_size")
    return decoded.select(
        F.lower("ics_protocol").alias("protocol"),
        *ENVELOPE,
        size.alias("payload_size"),
        "modbus",
        "dnp3",
        "opcua",
        *[c for c in ("msg_id", "ingest_ts") if c in decoded.columns],
    )


def parse_event_time(timestamp: Column, fallback: Column) -> Column:
    """ISO-8601 text to a timestamp; missing or unreadable text takes the arrival time."""
    return F.coalesce(F.try_to_timestamp(timestamp), fallback)


def normalise_message(df: DataFrame) -> DataFrame:
    """Key fields with their defaults: `unknown` addresses, `protocol` else `ics_protocol`."""
    alternatives = [F.col(c) for c in ("protocol", "ics_protocol") if c in df.columns]
    return (
        df.withColumn("src_ip", F.coalesce("src_ip", F.lit("unknown")))
        .withColumn("dst_ip", F.coalesce("dst_ip", F.lit("unknown")))
        .withColumn("protocol", F.coalesce(*alternatives, F.lit("unknown")))
    )


def _top_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def unnest_message(df: DataFrame, arrival: str = "ingest_ts") -> DataFrame:
    """Flat feature columns out of JSON messages whose body may be nested or at top level.

    Modbus function code and unit look at the top level first; every other field is read
    from the nested body when there is one, else from the top.
    """
    has_body = F.col("message").isNotNull()

    def field(name: str) -> Column:
        return F.when(has_body, F.col(f"message.{name}")).otherwise(_top_or_null(df, name))

    def top_first(name: str) -> Column:
        return F.coalesce(_top_or_null(df, name), F.col(f"message.{name}"))

    application = field("application")
    objects = application["objects"]
    arrived = F.col(arrival) if arrival in df.columns else F.lit(None).cast("timestamp")
    expressions = {
        "src_ip": F.col("src_ip"),
        "dst_ip": F.col("dst_ip"),
        "protocol": F.col("protocol"),
        "ts_us": F.unix_micros(parse_event_time(F.col("timestamp"), arrived)),
        "has_time": F.try_to_timestamp(F.col("timestamp")).isNotNull(),
        "msg_id": _top_or_null(df, "msg_id"),
        "payload_size": F.col("payload_size"),
        "src_port": F.col("src_port"),
        "dst_port": F.col("dst_port"),
        "function_code": top_first("function_code"),
        "unit_id": top_first("unit_id"),
        "start_address": field("start_address"),
        "quantity": field("quantity"),
        "is_exception": field("is_exception"),
        "exception_code": field("exception_code"),
        "values": F.when(has_body, F.col("message.values")),
        # an application code of 0 falls through to the link code
        "dnp3_code": F.when(
            F.lower("protocol") == "dnp3",
            F.coalesce(F.nullif(application["function_code"], F.lit(0)), field("function_code")),
        ),
        "dnp3_source": field("source"),
        "dnp3_destination": field("destination"),
        "is_master": field("is_master"),
        "unsolicited": application["control"]["unsolicited"],
        "object_groups": F.transform(objects, lambda o: o["group"]),
        "message_type": field("message_type"),
        "secure_channel_id": field("secure_channel_id"),
        "security_token_id": field("security_token_id"),
        "service_type": field("service_type"),
        "sequence_number": field("sequence_number"),
    }
    return normalise_message(df).select(
        *[expressions[name].cast(kind).alias(name) for name, kind in FLAT_COLUMNS.items()]
    )


def flatten_envelope(df: DataFrame, arrival: str = "ingest_ts") -> DataFrame:
    """The same flat columns straight from the wide decoded rows."""
    arrived = F.col(arrival) if arrival in df.columns else F.lit(None).cast("timestamp")
    app = F.col("dnp3.application")
    expressions = {
        "src_ip": F.col("src_ip"),
        "dst_ip": F.col("dst_ip"),
        "protocol": F.col("protocol"),
        "ts_us": F.unix_micros(parse_event_time(F.col("timestamp"), arrived)),
        "has_time": F.try_to_timestamp(F.col("timestamp")).isNotNull(),
        "msg_id": _top_or_null(df, "msg_id"),
        "payload_size": F.col("payload_size"),
        "src_port": F.col("src_port"),
        "dst_port": F.col("dst_port"),
        "dnp3_code": F.coalesce(
            F.nullif(app["function_code"], F.lit(0)), F.col("dnp3.function_code")
        ),
        "dnp3_source": F.col("dnp3.source"),
        "dnp3_destination": F.col("dnp3.destination"),
        "is_master": F.col("dnp3.is_master"),
        "unsolicited": app["control"]["unsolicited"],
        "object_groups": F.transform(app["objects"], lambda o: o["group"]),
    }
    for name in ("function_code", "unit_id", "start_address", "quantity", "is_exception",
                 "exception_code", "values"):
        expressions[name] = F.col(f"modbus.{name}")
    for name in ("message_type", "secure_channel_id", "security_token_id", "service_type",
                 "sequence_number"):
        expressions[name] = F.col(f"opcua.{name}")
    return normalise_message(df).select(
        *[expressions[name].cast(kind).alias(name) for name, kind in FLAT_COLUMNS.items()]
    )


def validate_messages(df: DataFrame, as_of: Column, max_skew_s: int = CLOCK_SKEW_S) -> DataFrame:
    """Messages with `violations` (reject) and `warnings` (keep) as arrays of rule names."""
    code = F.col("function_code")
    known_codes = {
        "modbus": F.lower("protocol") == "modbus",
        "dnp3": F.lower("protocol") == "dnp3",
    }
    bad_code = (
        known_codes["modbus"] & ~code.isin(*names.MODBUS_FUNCTIONS)
    ) | (
        known_codes["dnp3"]
        & ~code.isin(*(set(names.DNP3_LINK_FUNCTIONS) | set(names.DNP3_APPLICATION_FUNCTIONS)))
    )
    when = F.try_to_timestamp(F.col("timestamp"))
    skew = F.abs(F.unix_seconds(when) - F.unix_seconds(as_of))
    bad_port = lambda c: (F.col(c) < 0) | (F.col(c) > 65535)
    rule = lambda condition, name: F.when(
        F.coalesce(condition, F.lit(False)), F.lit(name)
    )
    violations = F.array_compact(F.array(
        rule(F.col("timestamp").isNull() | (F.col("timestamp") == ""), "missing_timestamp"),
        rule(F.col("src_ip").isNull(), "missing_src_ip"),
        rule(F.col("protocol").isNull(), "missing_protocol"),
        rule(~is_ip(F.col("src_ip")), "bad_src_ip"),
        rule(~is_ip(F.col("dst_ip")), "bad_dst_ip"),
    ))
    warnings = F.array_compact(F.array(
        rule(bad_port("src_port") | bad_port("dst_port"), "port_range"),
        rule(bad_code, "function_code"),
        rule(skew > max_skew_s, "clock_skew"),
    ))
    return df.withColumn("violations", violations).withColumn("warnings", warnings)


def session_id(src: Column, dst: Column) -> Column:
    """The same id for both directions of a conversation."""
    return F.xxhash64(F.least(src, dst), F.greatest(src, dst))


def enrich_messages(df: DataFrame, devices: DataFrame, ingest_ts: Column) -> DataFrame:
    """Ingest time, session id, direction and the device types of both ends.

    `devices(ip, device_type)` is an inventory; it is joined without a hint, so adaptive
    execution broadcasts it only when its measured size allows that.
    """
    inventory = devices.select("ip", "device_type")
    src = inventory.select(F.col("ip").alias("src_ip"), F.col("device_type").alias("src_device_type"))
    dst = inventory.select(F.col("ip").alias("dst_ip"), F.col("device_type").alias("dst_device_type"))
    to_server = F.col("dst_port").isin(*names.PORT_PROTOCOL)
    from_server = F.col("src_port").isin(*names.PORT_PROTOCOL)
    return (
        df.withColumn("ingest_timestamp", ingest_ts)
        .withColumn("session_id", session_id(F.col("src_ip"), F.col("dst_ip")))
        .withColumn(
            "direction",
            F.when(to_server, "request").when(from_server, "response").otherwise("unknown"),
        )
        .join(src, "src_ip", "left")
        .join(dst, "dst_ip", "left")
    )

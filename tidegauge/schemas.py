"""Record shapes that travel between the stages."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW_PACKET = _struct(
    timestamp=S, src_ip=S, dst_ip=S, src_port=I, dst_port=I, protocol=S, ics_protocol=S,
    payload_size=L, payload_hex=S,
)

MODBUS = _struct(
    transaction_id=I, protocol_id=I, length=I, unit_id=I, function_code=I, function_name=S,
    is_exception=B, exception_code=I, start_address=I, quantity=I, byte_count=I,
    values=T.ArrayType(I), coil_status=T.ArrayType(B), raw_data=S,
)

DNP3_OBJECT = _struct(group=I, variation=I, qualifier=I, description=S, count=I, data=S)
DNP3_TRANSPORT = _struct(final_fragment=B, first_fragment=B, sequence=I)
DNP3_CONTROL = _struct(
    final_fragment=B, first_fragment=B, confirm_expected=B, unsolicited=B, sequence=I
)
DNP3_APPLICATION = _struct(
    control=DNP3_CONTROL, function_code=I, function_name=S, internal_indications=I,
    objects=T.ArrayType(DNP3_OBJECT),
)
DNP3 = _struct(
    start_bytes=I, length=I, control=I, destination=I, source=I, is_master=B, frame_count_bit=B,
    frame_count_valid=B, function_code=I, function_name=S, transport_header=DNP3_TRANSPORT,
    application=DNP3_APPLICATION, raw_payload=S,
)

OPCUA = _struct(
    message_type=S, message_type_code=T.ArrayType(I), is_final=B, message_size=L,
    secure_channel_id=L, protocol_version=L, receive_buffer_size=L, send_buffer_size=L,
    max_message_size=L, max_chunk_count=L, endpoint_url=S, security_token_id=L, sequence_number=L,
    request_id=L, service_type=S, raw_payload=S,
)


def _merged(*parts: T.StructType) -> T.StructType:
    fields: dict[str, T.StructField] = {}
    for part in parts:
        for field in part.fields:
            fields.setdefault(field.name, field)
    return T.StructType(list(fields.values()))


# the JSON form of a decoded message keeps its body under one name, so the body is the union
MESSAGE_BODY = _merged(MODBUS, DNP3, OPCUA)

MESSAGE = T.StructType(
    _struct(
        protocol=S, ics_protocol=S, timestamp=S, src_ip=S, dst_ip=S, src_port=I, dst_port=I,
        payload_size=L,
    ).fields
    + [T.StructField("message", MESSAGE_BODY)]
    + [f for f in MESSAGE_BODY.fields if f.name not in ("length", "control", "values")]
)

WINDOW_KEY = _struct(src_ip=S, dst_ip=S, protocol=S, window_size=I, window_start=L)

MODEL_SCORE = _struct(model_name=S, score=D, weight=D, raw_score=D, inference_time_ms=D)

ANOMALY = _struct(
    window_key=WINDOW_KEY, detected_at=T.TimestampType(), model_scores=T.ArrayType(MODEL_SCORE),
    ensemble_score=D, classification=S, anomaly_type=S, confidence=D,
    feature_contributions=T.MapType(S, D),
)

ALERT_SOURCE = WINDOW_KEY

ALERT = _struct(
    id=S, incident_id=S, created_at=T.TimestampType(), severity=S, status=S, title=S,
    description=S, source=ALERT_SOURCE, anomaly_type=S, ensemble_score=D, confidence=D,
    related_anomaly_count=I, feature_contributions=T.MapType(S, D),
)

INCIDENT = _struct(
    id=S, correlation_key=S, created_at=T.TimestampType(), updated_at=T.TimestampType(), status=S,
    priority=S, anomaly_count=L, alert_ids=T.ArrayType(S), max_ensemble_score=D,
    src_ips=T.ArrayType(S), dst_ips=T.ArrayType(S), anomaly_types=T.ArrayType(S), title=S,
    description=S,
)

# volume and timing columns every feature vector carries
VECTOR_CORE: list[tuple[str, T.DataType]] = [
    ("message_count", L), ("bytes_total", L), ("bytes_mean", D), ("bytes_std", D),
    ("bytes_min", L), ("bytes_max", L), ("iat_mean", D), ("iat_std", D), ("iat_min", D),
    ("iat_max", D), ("iat_median", D),
]
MODBUS_EXTRAS: list[tuple[str, T.DataType]] = [
    ("fc_unique_count", L), ("fc_read_ratio", D), ("fc_write_ratio", D),
    ("fc_diagnostic_ratio", D), ("fc_entropy", D), ("fc_most_common", L),
    ("fc_most_common_ratio", D), ("unit_id_unique_count", L), ("unit_id_entropy", D),
    ("addr_unique_count", L), ("addr_mean", D), ("addr_std", D), ("addr_min", L), ("addr_max", L),
    ("addr_range", L), ("qty_mean", D), ("qty_max", L), ("exception_count", L),
    ("exception_ratio", D), ("exception_codes_unique", L), ("request_count", L),
    ("response_count", L), ("request_ratio", D),
]
DNP3_EXTRAS: list[tuple[str, T.DataType]] = [
    ("fc_unique_count", L), ("fc_read_ratio", D), ("fc_write_ratio", D), ("fc_control_ratio", D),
    ("fc_response_ratio", D), ("fc_entropy", D), ("dnp3_src_unique", L), ("dnp3_dst_unique", L),
    ("dnp3_addr_pairs", L), ("obj_group_unique", L), ("obj_binary_input_ratio", D),
    ("obj_binary_output_ratio", D), ("obj_analog_input_ratio", D), ("obj_analog_output_ratio", D),
    ("master_ratio", D), ("unsolicited_count", L), ("unsolicited_ratio", D),
]
OPCUA_EXTRAS: list[tuple[str, T.DataType]] = [
    ("msg_type_unique", L), ("msg_handshake_ratio", D), ("msg_data_ratio", D),
    ("msg_error_ratio", D), ("msg_type_entropy", D), ("channel_unique", L), ("token_unique", L),
    ("channel_reuse_ratio", D), ("service_unique", L), ("service_open_channel", L),
    ("service_close_channel", L), ("service_error", L), ("sequence_gaps", L),
]


def _vector() -> T.StructType:
    seen: dict[str, T.DataType] = {}
    for name, kind in VECTOR_CORE + MODBUS_EXTRAS + DNP3_EXTRAS + OPCUA_EXTRAS:
        seen.setdefault(name, kind)
    head = [
        T.StructField("window_key", WINDOW_KEY), T.StructField("extracted_at", T.TimestampType()),
        T.StructField("protocol", S), T.StructField("window_size_seconds", I),
    ]
    return T.StructType(head + [T.StructField(n, k) for n, k in seen.items()])


FEATURE_VECTOR = _vector()

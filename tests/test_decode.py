"""Payload bytes with known contents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import bytes as by
from tidegauge.functions import names
from tidegauge.operators import envelope, packets

PACKET = ("2024-01-15T10:30:00Z", "192.168.1.1", "192.168.1.2", 49152, 502, "tcp", 12)
COLUMNS = "timestamp string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, payload_size bigint, ics_protocol string, payload_hex string"


def rows_of(spark, protocol, *payloads):
    return spark.createDataFrame([(*PACKET, protocol, p) for p in payloads], COLUMNS)


RANGED = "640510440100020000ff" + "c0" + "d081" + "3412" + "1e0100" + "0207" + "aa"
BACKWARDS = "640510440100020000ff" + "c0" + "c081" + "0000" + "010200" + "0702"
NUMBERS = "4d53474320000000" + "ffffffff" + "c3000000" + "80000000" + "fe000000" + "aabbccdd"
PAYLOADS = [
    ("dnp3", "640505c0010002000000"),
    ("dnp3", "64050cc4010002000000c0c1013c020100"),
    ("modbus", "0001000000020163"),
    ("modbus", "0001000000030183"),
    ("modbus", "000100000003018302"),
    ("modbus", "000100000005012b0E0100"),
    ("modbus", "00010000000601030000000a"),
    ("modbus", "000100000006010303aabbcc"),
    ("modbus", "00010000000b0103080001000200030004"),
    ("modbus", "0005000000060105000aff00"),
    ("modbus", "000700000008010f0013000a02cd01"),
    ("opcua", "48454c462c000000000000000000010000000100000000000000000000000000"),
    ("opcua", "fffefd4608000000"),
    ("dnp3", RANGED),
    ("dnp3", BACKWARDS),
    ("opcua", NUMBERS),
]


@pytest.fixture(scope="module")
def decode(spark):
    """All payloads decoded in one job, looked up by protocol and payload."""
    frame = spark.createDataFrame([(*PACKET, *pair) for pair in PAYLOADS], COLUMNS)
    found = {
        (r["ics_protocol"], r["payload_hex"]): (r[r["ics_protocol"]], r["reject_reason"])
        for r in envelope.decode_packets(frame).collect()
    }
    return lambda protocol, payload: found[protocol, payload]


def test_modbus_read_request(decode):
    m, _ = decode("modbus", "00010000000601030000000a")
    assert (m.transaction_id, m.protocol_id, m.length, m.unit_id) == (1, 0, 6, 1)
    assert (m.function_code, m.function_name) == (3, "Read Holding Registers")
    assert (m.is_exception, m.start_address, m.quantity, m["values"]) == (False, 0, 10, None)


def test_modbus_read_response(decode):
    m, _ = decode("modbus", "00010000000b0103080001000200030004")
    assert (m.byte_count, m["values"], m.start_address) == (8, [1, 2, 3, 4], None)


def test_modbus_four_byte_response_reads_as_request(decode):
    m, _ = decode("modbus", "000100000006010303aabbcc")
    assert (m.start_address, m.quantity, m.byte_count) == (0x03AA, 0xBBCC, None)


def test_modbus_exception(decode):
    m, _ = decode("modbus", "000100000003018302")
    assert (m.function_code, m.is_exception, m.exception_code) == (3, True, 2)
    bare, _ = decode("modbus", "0001000000030183")
    assert (bare.is_exception, bare.exception_code) == (True, None)


def test_modbus_writes(decode):
    coil, _ = decode("modbus", "0005000000060105000aff00")
    assert (coil.start_address, coil["values"]) == (10, [65280])
    many, _ = decode("modbus", "000700000008010f0013000a02cd01")
    assert (many.start_address, many.quantity, many.byte_count, many["values"]) == (19, 10, 2, [0xCD01])


def test_modbus_other_function_keeps_raw(decode):
    m, _ = decode("modbus", "000100000005012b0E0100")
    assert (m.function_name, m.raw_data) == ("Encapsulated Interface Transport", "0e0100")
    unknown, _ = decode("modbus", "0001000000020163")
    assert (unknown.function_name, unknown.raw_data) == ("Unknown (0x63)", "")


def test_dnp3_link_frame(decode):
    d, _ = decode("dnp3", "640505c0010002000000")
    assert (d.start_bytes, d.is_master, d.destination, d.source) == (0x0564, True, 1, 2)
    assert (d.function_code, d.function_name, d.application) == (0, "Reset Link States", None)


def test_dnp3_application_layer(decode):
    d, _ = decode("dnp3", "64050cc4010002000000c0c1013c020100")
    assert d.function_name == "Unconfirmed User Data"
    assert (d.transport_header.final_fragment, d.transport_header.sequence) == (True, 0)
    assert (d.application.function_code, d.application.function_name) == (1, "Read")
    assert d.application.internal_indications is None
    (first,) = d.application.objects
    assert (first.group, first.variation, first['count'], first.data) == (60, 2, None, "00")


def test_dnp3_response_has_indications_and_ranges(decode):
    d, _ = decode("dnp3", RANGED)
    assert (d.is_master, d.application.control.unsolicited) == (False, True)
    assert d.application.internal_indications == 0x1234
    (ranged,) = d.application.objects
    assert (ranged.description, ranged['count'], ranged.data) == ("Analog Input", 6, "aa")
    backwards, _ = decode("dnp3", BACKWARDS)
    assert backwards.application.objects[0]['count'] is None


def test_opcua_hello(decode):
    u, _ = decode("opcua", "48454c462c000000000000000000010000000100000000000000000000000000")
    assert (u.message_type, u.is_final, u.message_size, u.protocol_version) == ("Hello", True, 44, 0)
    assert (u.receive_buffer_size, u.endpoint_url) == (65536, None)
    assert list(u.message_type_code) == [0x48, 0x45, 0x4C]


def test_opcua_numbers_above_a_sign_bit(decode):
    u, _ = decode("opcua", NUMBERS)
    assert (u.message_type, u.is_final, u.secure_channel_id) == ("Message", False, 4294967295)
    assert (u.security_token_id, u.sequence_number) == (0xC3, 0x80)
    assert (u.request_id, u.raw_payload) == (0xFE, "aabbccdd")


def test_opcua_unreadable_type(decode):
    u, _ = decode("opcua", "fffefd4608000000")
    assert u.message_type == 'Unknown ("???")'


def test_rejects(spark):
    wanted = [
        ("modbus", "000100", "undecodable"),
        ("dnp3", "6405", "undecodable"),
        ("dnp3", "056405c0010002000000", "undecodable"),
        ("opcua", "48454c", "undecodable"),
        ("modbus", "zz", "bad_hex"),
        ("modbus", "001", "bad_hex"),
        ("modbus", None, "bad_hex"),
        ("ethernet_ip", "0011", "unknown_protocol"),
        ("modbus", "", "undecodable"),
    ]
    frame = spark.createDataFrame([(*PACKET, p, h) for p, h, _ in wanted], COLUMNS)
    rows = envelope.decode_packets(frame).collect()
    assert [r["reject_reason"] for r in rows] == [reason for _, _, reason in wanted]
    assert all((r["modbus"], r["dnp3"], r["opcua"]) == (None, None, None) for r in rows)


def test_decoding_stays_in_the_jvm_without_shuffle(spark):
    plan = envelope.decode_packets(rows_of(spark, "modbus", "00"))._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString() and "Python" not in plan.toString()


def test_ports_name_protocols(spark):
    frame = spark.createDataFrame(
        [(502, 1), (1, 502), (20000, 502), (4840, 1), (44818, 1), (80, 81)], "d int, s int"
    )
    got = [r[0] for r in frame.select(names.ics_protocol(F.col("d"), F.col("s"))).collect()]
    assert got == ["modbus", "modbus", "dnp3", "opcua", "ethernet_ip", "unknown"]


def test_filter_and_flow_records(spark):
    frame = rows_of(spark, "modbus", "00010000000601030000000a", "0001")
    assert packets.filter_packets(frame).count() == 2
    assert packets.filter_packets(frame.withColumn("payload_size", F.lit(0))).count() == 0
    assert packets.filter_packets(frame.withColumn("protocol", F.lit("icmp"))).count() == 0
    got = [(r.payload_len, r.function_code) for r in packets.flow_records(frame).collect()]
    assert got == [(12, 3), (2, None)]


def test_zero_bytes_option(spark):
    kept, _ = envelope.route_by_protocol(rows_of(spark, "modbus", "00010000000601030000000a"))
    assert envelope.to_envelope(kept).first().payload_size == 12
    assert envelope.to_envelope(kept, compat_zero_bytes=True).first().payload_size is None


def test_little_endian_bytes(spark):
    frame = spark.createDataFrame([("c300ff80",)], "h string")
    row = frame.select(by.u16le(F.col("h"), 0), by.u16be(F.col("h"), 0), by.u32le(F.col("h"), 0)).first()
    assert tuple(row) == (0xC3, 0xC300, 0x80FF00C3)


def test_ip_formats(spark):
    texts = ["10.0.0.1", "256.1.1.1", "1.2.3", "::1", "fe80::1", "2001:db8:0:0:0:0:0:1", "g::1", "1::2::3"]
    frame = spark.createDataFrame([(t,) for t in texts], "ip string")
    got = [r[0] for r in frame.select(packets.is_ip(F.col("ip"))).collect()]
    assert got == [True, False, False, True, True, True, False, False]

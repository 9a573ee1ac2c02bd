"""Fixed tables of the wire protocols and of the anomaly vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.text import lookup

# ---- fixed values: port numbers -------------------------------------------------------------
PORT_PROTOCOL = {502: "modbus", 20000: "dnp3", 4840: "opcua", 44818: "ethernet_ip"}

# ---- fixed values: Modbus function codes ----------------------------------------------------
MODBUS_FUNCTIONS = {
    1: "Read Coils",
    2: "Read Discrete Inputs",
    3: "Read Holding Registers",
    4: "Read Input Registers",
    5: "Write Single Coil",
    6: "Write Single Register",
    7: "Read Exception Status",
    8: "Diagnostics",
    11: "Get Comm Event Counter",
    12: "Get Comm Event Log",
    15: "Write Multiple Coils",
    16: "Write Multiple Registers",
    17: "Report Server ID",
    20: "Read File Record",
    21: "Write File Record",
    22: "Mask Write Register",
    23: "Read/Write Multiple Registers",
    24: "Read FIFO Queue",
    43: "Encapsulated Interface Transport",
}
MODBUS_READ = [1, 2, 3, 4]
MODBUS_WRITE = [5, 6, 15, 16]
MODBUS_DIAGNOSTIC = [7, 8, 11, 12, 17]

# ---- fixed values: DNP3 link, application and object names ----------------------------------
DNP3_LINK_FUNCTIONS = {
    0: "Reset Link States",
    1: "Reset User Process",
    2: "Test Link States",
    3: "Confirmed User Data",
    4: "Unconfirmed User Data",
    9: "Request Link Status",
    11: "Respond Link Status",
}
DNP3_APPLICATION_FUNCTIONS = {
    0: "Confirm",
    1: "Read",
    2: "Write",
    3: "Select",
    4: "Operate",
    5: "Direct Operate",
    6: "Direct Operate No Ack",
    7: "Immediate Freeze",
    8: "Immediate Freeze No Ack",
    9: "Freeze and Clear",
    10: "Freeze and Clear No Ack",
    11: "Freeze With Time",
    12: "Freeze With Time No Ack",
    13: "Cold Restart",
    14: "Warm Restart",
    15: "Initialize Data",
    16: "Initialize Application",
    17: "Start Application",
    18: "Stop Application",
    19: "Save Configuration",
    20: "Enable Unsolicited",
    21: "Disable Unsolicited",
    22: "Assign Class",
    23: "Delay Measure",
    24: "Record Current Time",
    25: "Open File",
    26: "Close File",
    27: "Delete File",
    28: "Get File Info",
    29: "Authenticate File",
    30: "Abort File",
    129: "Response",
    130: "Unsolicited Response",
}
DNP3_OBJECT_GROUPS = {
    1: "Binary Input",
    2: "Binary Input Event",
    3: "Double-bit Binary Input",
    10: "Binary Output",
    12: "Binary Output Command",
    20: "Counter",
    21: "Frozen Counter",
    30: "Analog Input",
    32: "Analog Input Event",
    40: "Analog Output Status",
    41: "Analog Output",
    50: "Time and Date",
    60: "Class Data",
    80: "Internal Indications",
}
DNP3_READ = [1]
DNP3_WRITE = [2, 3, 4, 5, 6]
DNP3_RESTART = [13, 14]
DNP3_RESPONSE = [129, 130]
DNP3_BINARY_INPUT = [1, 2]
DNP3_BINARY_OUTPUT = [10, 12]
DNP3_ANALOG_INPUT = [30, 32]
DNP3_ANALOG_OUTPUT = [40, 41]

# ---- fixed values: OPC-UA message types -----------------------------------------------------
OPCUA_TYPES = {
    "HEL": "Hello",
    "ACK": "Acknowledge",
    "OPN": "OpenSecureChannel",
    "MSG": "Message",
    "CLO": "CloseSecureChannel",
    "ERR": "Error",
}
OPCUA_HANDSHAKE = ["Hello", "Acknowledge", "OpenSecureChannel", "CloseSecureChannel"]
OPCUA_DATA = ["Message"]
OPCUA_ERROR = ["Error"]

# ---- fixed values: severity and technique by anomaly type -----------------------------------
TYPE_SEVERITY = {
    "command_injection": "critical",
    "protocol_violation": "critical",
    "unauthorized_access": "high",
    "data_exfiltration": "high",
    "reconnaissance": "high",
    "volume_anomaly": "medium",
    "timing_anomaly": "medium",
    "unknown": "medium",
}
TYPE_TECHNIQUE = {
    "reconnaissance": "T0846 - Remote System Discovery",
    "protocol_violation": "T0855 - Unauthorized Command Message",
    "value_manipulation": "T0879 - Damage to Property",
    "timing_anomaly": "T0882 - Theft of Operational Information",
    "command_injection": "T0831 - Manipulation of Control",
    "unauthorized_access": "T0821 - Modify Controller Tasking",
    "data_exfiltration": "T0882 - Theft of Operational Information",
}


def _named(table: dict[int, str], code: Column) -> Column:
    unknown = F.concat(F.lit("Unknown (0x"), F.lpad(F.hex(code), 2, "0"), F.lit(")"))
    return lookup(table, code, unknown)


def modbus_function_name(code: Column) -> Column:
    return _named(MODBUS_FUNCTIONS, code)


def dnp3_link_name(code: Column) -> Column:
    return _named(DNP3_LINK_FUNCTIONS, code)


def dnp3_application_name(code: Column) -> Column:
    return _named(DNP3_APPLICATION_FUNCTIONS, code)


def dnp3_object_name(group: Column, variation: Column) -> Column:
    other = F.concat(
        F.lit("Group "), group.cast("string"), F.lit(" Variation "), variation.cast("string")
    )
    return lookup(DNP3_OBJECT_GROUPS, group, other)


def protocol_from_port(port: Column) -> Column:
    return lookup(PORT_PROTOCOL, port, F.lit("unknown"))


def ics_protocol(dst_port: Column, src_port: Column) -> Column:
    """The destination port decides; the source port only where the first is unknown."""
    return F.coalesce(
        lookup(PORT_PROTOCOL, dst_port), lookup(PORT_PROTOCOL, src_port), F.lit("unknown")
    )

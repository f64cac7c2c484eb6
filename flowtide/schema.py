"""Record layouts and column names shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# The 76 canonical flow features, in model order.
FEATURE_NAMES = [
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s",
    "Min Packet Length", "Max Packet Length",
    "Packet Length Mean", "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count",
    "ACK Flag Count", "URG Flag Count", "CWE Flag Count", "ECE Flag Count",
    "Down/Up Ratio", "Average Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "Init_Win_bytes_forward", "Init_Win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]

# Header spellings that differ from a canonical name by more than case.
EXTRA_ALIASES = {
    "totlen fwd packets": "Total Length of Fwd Packets",
    "totlen bwd packets": "Total Length of Bwd Packets",
}

# Accepted label headers and metadata headers that are no features.
LABEL_COLUMNS = ["Label", "label", "Class", "class", "Attack", "attack", "Category"]
METADATA_COLUMNS = [
    "Flow ID", "Source IP", "Destination IP", "Source Port", "Destination Port",
    "Protocol", "Timestamp", "SimillarHTTP", "Inbound",
]
MIN_FEATURES = 10

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

# TCP flag bits.
TCP_FLAGS = {
    "fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08,
    "ack": 0x10, "urg": 0x20, "ece": 0x40, "cwe": 0x80,
}


def snake(name: str) -> str:
    """Column-friendly form of a canonical feature name."""
    return name.strip().lower().replace("/s", "_per_s").replace("/", "_").replace(" ", "_")


FEATURE_COLUMNS = [snake(n) for n in FEATURE_NAMES]
CANONICAL_BY_KEY = {**{n.lower(): n for n in FEATURE_NAMES}, **EXTRA_ALIASES}

PACKET_SCHEMA = T.StructType([
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("pkt_len", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("header_len", T.IntegerType()),
    T.StructField("win_size", T.IntegerType()),
    T.StructField("payload_len", T.IntegerType()),
    T.StructField("seq", T.LongType()),
])

DETECTION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("destination_ip", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("destination_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("severity", T.StringType()),
    T.StructField("is_intrusion", T.BooleanType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("batch", T.BooleanType()),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("status", T.StringType()),
])

AUDIT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("event", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ip_address", T.StringType()),
])

LIFECYCLE_SCHEMA = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("kind", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("actor", T.StringType()),
    T.StructField("text", T.StringType()),
])

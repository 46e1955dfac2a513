"""Names, vocabularies and schemas of the flow tables."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# The 30 canonical features, in model order, each with the header that the
# public raw flow dataset gives it.
FEATURE_HEADERS = {
    "flow_duration": "Flow Duration",
    "total_fwd_packets": "Total Fwd Packets",
    "total_bwd_packets": "Total Backward Packets",
    "total_length_fwd_packets": "Total Length of Fwd Packets",
    "total_length_bwd_packets": "Total Length of Bwd Packets",
    "fwd_packet_length_mean": "Fwd Packet Length Mean",
    "fwd_packet_length_std": "Fwd Packet Length Std",
    "bwd_packet_length_mean": "Bwd Packet Length Mean",
    "bwd_packet_length_std": "Bwd Packet Length Std",
    "flow_bytes_per_sec": "Flow Bytes/s",
    "flow_packets_per_sec": "Flow Packets/s",
    "flow_iat_mean": "Flow IAT Mean",
    "flow_iat_std": "Flow IAT Std",
    "flow_iat_max": "Flow IAT Max",
    "fwd_iat_total": "Fwd IAT Total",
    "fwd_iat_mean": "Fwd IAT Mean",
    "fwd_iat_std": "Fwd IAT Std",
    "bwd_iat_total": "Bwd IAT Total",
    "bwd_iat_mean": "Bwd IAT Mean",
    "bwd_iat_std": "Bwd IAT Std",
    "fwd_packets_per_sec": "Fwd Packets/s",
    "bwd_packets_per_sec": "Bwd Packets/s",
    "down_up_ratio": "Down/Up Ratio",
    "avg_packet_size": "Average Packet Size",
    "avg_fwd_segment_size": "Avg Fwd Segment Size",
    "avg_bwd_segment_size": "Avg Bwd Segment Size",
    "subflow_fwd_packets": "Subflow Fwd Packets",
    "subflow_bwd_packets": "Subflow Bwd Packets",
    "subflow_fwd_bytes": "Subflow Fwd Bytes",
    "subflow_bwd_bytes": "Subflow Bwd Bytes",
}
# Features held as whole numbers in a flow record.
COUNTERS = (
    "total_fwd_packets",
    "total_bwd_packets",
    "subflow_fwd_packets",
    "subflow_bwd_packets",
)
# Features that must not be negative (durations, packets, bytes, rates).
NON_NEGATIVE = (
    "flow_duration",
    "total_fwd_packets",
    "total_bwd_packets",
    "total_length_fwd_packets",
    "total_length_bwd_packets",
    "flow_bytes_per_sec",
    "flow_packets_per_sec",
)
# Identity fields: accepted column names in order of preference, and default.
IDENTITY_ALIASES = {
    "timestamp": (("timestamp", "Timestamp", "time"), None),
    "src_ip": (("src_ip", "Source IP", "SourceIP", "Src IP"), "0.0.0.0"),
    "dst_ip": (("dst_ip", "Destination IP", "DestinationIP", "Dst IP"), "0.0.0.0"),
    "src_port": (("src_port", "Source Port", "Src Port"), "0"),
    "dst_port": (("dst_port", "Destination Port", "Dst Port"), "0"),
    "protocol": (("protocol", "Protocol"), "TCP"),
}
# Categories by id.
LABELS = ("Normal", "DoS", "Port Scan", "Brute Force", "Data Exfiltration")
LABEL_COLUMN = "Label"
# Production targets of a performance report.
TARGETS = {
    "p95_latency_ms": 50.0,
    "fpr": 0.02,
    "throughput_fps": 100000.0,
    "f1_macro": 0.97,
}
# --- end of fixed values ----------------------------------------------------

FEATURES = tuple(FEATURE_HEADERS)
NORMAL = LABELS[0]

FLOW_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.LongType()),
        T.StructField("dst_port", T.LongType()),
        T.StructField("protocol", T.StringType()),
    ]
    + [
        T.StructField(name, T.LongType() if name in COUNTERS else T.DoubleType())
        for name in FEATURES
    ]
)

ATTRIBUTION = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("abs_importance", T.DoubleType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("attack_type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("top_3_features", T.ArrayType(ATTRIBUTION)),
        T.StructField("severity", T.StringType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("flow_features", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("alert", ALERT_SCHEMA),
    ]
)

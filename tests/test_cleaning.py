import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetloom.functions.labels import decode_label, encode_label, map_labels
from packetloom.functions.values import (
    check_threshold,
    coerce_double,
    coerce_long,
    is_valid_ipv4,
    sanitize,
)
from packetloom.operators.features import (
    engineer_features,
    require_columns,
    sanitize_strings,
    to_flows,
)
from packetloom.operators.validation import validate_features, validate_requests
from packetloom.schemas import FEATURES, FLOW_SCHEMA, LABELS

CASES = {
    "BENIGN": "Normal",
    "benign": "Normal",
    "Normal": "Normal",
    "  BENIGN ": "Normal",
    " BENIGN ": "Normal",
    "DoS Hulk": "DoS",
    "DOS slowloris": "DoS",
    "DDoS": "DoS",
    "Heartbleed": "DoS",
    "PortScan": "Port Scan",
    "port scan": "Port Scan",
    "FTP-Patator": "Brute Force",
    "SSH-Patator": "Brute Force",
    "Web Attack – Brute Force": "Brute Force",
    "Web Attack – XSS": "Data Exfiltration",
    "Infiltration": "Data Exfiltration",
    "Bot": "Data Exfiltration",
    "x sql injection": "Data Exfiltration",
    "normal": "Data Exfiltration",
    "unknown": "Data Exfiltration",
    "": "Data Exfiltration",
    None: "Data Exfiltration",
}


def _one(spark, value, kind, expr):
    frame = spark.createDataFrame([(value,)], f"x {kind}")
    return frame.select(expr(F.col("x")).alias("y")).first()["y"]


def test_label_rules(spark):
    frame = spark.createDataFrame([(k, v) for k, v in CASES.items()], "raw string, want string")
    got = frame.select("raw", "want", map_labels(F.col("raw")).alias("got"))
    assert [r for r in got.collect() if r["want"] != r["got"]] == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=50))
def test_labels_are_total(spark, texts):
    frame = spark.createDataFrame([(t.replace("\x00", ""),) for t in texts], "raw string")
    got = frame.select(map_labels(F.col("raw")).alias("c"), F.col("raw"))
    assert {r["c"] for r in got.collect()} <= set(LABELS)


def test_ids_and_back(spark):
    frame = spark.range(7).select(
        "id",
        decode_label(F.col("id")).alias("name"),
        encode_label(decode_label(F.col("id"))).alias("back"),
    )
    rows = frame.orderBy("id").collect()
    assert [r["name"] for r in rows] == [*LABELS, "5", "6"]
    assert [r["back"] for r in rows] == [0, 1, 2, 3, 4, 0, 0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Infinity", 0.0), ("-Infinity", 0.0), ("inf", 0.0), ("NaN", 0.0), ("", 0.0), ("abc", 0.0)]
    + [(None, 0.0), ("-3.9", -3.9), ("7.0", 7.0), (" 2 ", 2.0), ("1.5d", 0.0), ("0x1p3", 0.0)]
    + [("1e999", 0.0), ("1e3", 1000.0)],
)
def test_text_to_number(spark, text, want):
    assert _one(spark, text, "string", coerce_double) == want
    assert _one(spark, text, "string", coerce_long) == int(want)


def test_ipv4(spark):
    good = ["192.168.1.1", "10.0.0.1", "0.0.0.0", "255.255.255.255", "001.2.3.4"]
    bad = ["999.999.999.999", "192.168.1", "not.an.ip.address", "192.168.1.1.1", "1.2.3.4\n", "", None]
    frame = spark.createDataFrame([(x,) for x in good + bad], "ip string")
    got = [r["ok"] for r in frame.select(is_valid_ipv4(F.col("ip")).alias("ok")).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_sanitize(spark):
    assert _one(spark, "<b>Tom & Co</b>", "string", sanitize) == "bTom  Co/b"
    assert len(_one(spark, "a" * 5000, "string", sanitize)) == 1000
    row = sanitize_strings(spark.createDataFrame([("<x>", 123)], "s string, n int")).first()
    assert (row["s"], row["n"]) == ("x", 123)


def test_thresholds():
    for ok in (0.5, 0.0, 1.0, 1):
        assert check_threshold(ok) == ok
    for bad in (-0.1, 1.1, "0.5"):
        with pytest.raises(ValueError):
            check_threshold(bad)


def test_raw_headers_win_and_absent_columns_are_zero(spark):
    frame = spark.createDataFrame(
        [(1.0, -5.0, float("inf"), "7")],
        ["Flow Duration ", "flow_duration", " Flow Bytes/s", "Total Fwd Packets"],
    )
    out = engineer_features(frame)
    assert out.columns == list(FEATURES)
    row = out.first()
    assert (row["flow_duration"], row["flow_bytes_per_sec"], row["total_fwd_packets"]) == (1, 0, 7)
    assert row["down_up_ratio"] == 0


def test_flow_record_defaults(spark):
    frame = spark.createDataFrame(
        [("-3.9", "", "80.7", None)],
        "`Total Fwd Packets` string, ` Source IP` string, `Src Port` string, Protocol string",
    )
    out = to_flows(frame)
    assert [f.name for f in out.schema] == FLOW_SCHEMA.names
    assert [f.dataType for f in out.schema] == [f.dataType for f in FLOW_SCHEMA]
    row = out.first()
    assert (row["total_fwd_packets"], row["src_ip"], row["src_port"]) == (-3, "0.0.0.0", 80)
    assert (row["protocol"], row["dst_ip"]) == ("TCP", "0.0.0.0")
    assert "T" in row["timestamp"]


def _row(spark, **changes):
    values = {f: 1.0 for f in FEATURES} | changes
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{f} double" for f in FEATURES))


def test_validation_modes(spark):
    assert validate_features(_row(spark), "valid").count() == 1
    for value, reason in ((float("nan"), "nan"), (float("inf"), "inf"), (-1000.0, "negative"), (None, "null")):
        bad = _row(spark, flow_duration=value)
        found = validate_features(bad, "flag").first()["violations"]
        assert [(v["feature"], v["reason"]) for v in found] == [("flow_duration", reason)]
        assert validate_features(bad, "valid").count() == 0
        assert validate_features(bad, "quarantine").count() == 1
        with pytest.raises(Exception, match="invalid features"):
            validate_features(bad, "fail").collect()
    assert validate_features(_row(spark, flow_iat_mean=-1.0), "valid").count() == 1
    assert validate_requests(_row(spark, flow_iat_mean=-1.0), "valid").count() == 0
    assert validate_requests(_row(spark, total_fwd_packets=1.5), "valid").count() == 0
    with pytest.raises(ValueError, match="missing"):
        validate_features(_row(spark).drop("flow_duration"))


def test_missing_label_column(spark):
    with pytest.raises(ValueError, match="Label"):
        require_columns(_row(spark), "Label")

"""Flow tables derived from the check tables, once for Spark, once as SQL.

Every row of ``events`` becomes one flow. The expressions below are plain SQL
that both engines read alike; they plant the dirt that real captures hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.alerts import iso_time
from packetloom.schemas import FEATURE_HEADERS, FEATURES, LABELS

RAW_LABELS = (
    "BENIGN",
    "  BENIGN ",
    "benign",
    "Normal",
    "normal",
    "DoS Hulk",
    "DOS slowloris",
    "DDoS",
    "Heartbleed",
    "PortScan",
    "port scan",
    "FTP-Patator",
    "Web Attack – Brute Force",
    "Web Attack – XSS",
    "Bot",
)  # one more row in 16 has no label


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MODULI = (79, 83, 89, 97, 101, 103, 107, 109)


def _events_with_remainders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the remainders that all 30 features look at."""
    return table(spark, sf_dir, "events").selectExpr(
        "*", *[f"event_id % {m} as m{m}" for m in _MODULI]
    )


def _by_remainder(expr: str) -> str:
    for m in _MODULI:
        expr = expr.replace(f"event_id % {m} =", f"m{m} =")
    return expr


def dirty_feature(k: int) -> str:
    return (
        f"case when event_id % 97 = {k} then cast('Infinity' as double)"
        f" when event_id % 89 = {k} then cast('NaN' as double)"
        f" when event_id % 83 = {k} then cast(null as double)"
        f" when event_id % 79 = {k} then -(value * {k + 1}) - 1"
        f" else value * {k + 1} + event_id % {k + 7} end"
    )


def text_feature(k: int) -> str:
    return (
        f"case when event_id % 101 = {k} then 'abc' when event_id % 103 = {k} then ''"
        f" when event_id % 107 = {k} then '-3.9' when event_id % 109 = {k} then 'NaN'"
        f" else cast({dirty_feature(k)} as string) end"
    )


RAW_LABEL = (
    "case "
    + " ".join(f"when event_id % 16 = {i} then '{t}'" for i, t in enumerate(RAW_LABELS))
    + " end"
)
SRC_IP = (
    "concat('192.168.', cast(user_id % 256 as string), '.', cast(event_id % 300 as string))"
)
DST_IP = "concat('10.0.', cast(event_id % 7 as string), '.', cast(user_id % 290 as string))"
Y_TRUE = "cast(event_id % 5 as int)"
Y_PRED = (
    "cast(case when event_id % 11 < 9 then event_id % 5 else (event_id * 7) % 5 end as int)"
)
CONFIDENCE = "cast(event_id % 101 as double) / 100"
MEMORY = "value * 2 - 10"


def _name_of(expr: str) -> str:
    return "case " + " ".join(f"when {expr} = {i} then '{n}'" for i, n in enumerate(LABELS)) + " end"


PREDICTION = _name_of(Y_PRED)


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers under raw headers, some with blanks around them, and a stale
    canonical column that the raw one must replace."""
    headers = [
        f"{_by_remainder(dirty_feature(k))} as `{' ' * (k % 3)}{h}{' ' * (k % 2)}`"
        for k, h in enumerate(FEATURE_HEADERS.values())
    ]
    return _events_with_remainders(spark, sf_dir).selectExpr(
        "event_id as flow_id",
        "ts",
        f"{RAW_LABEL} as Label",
        "cast(-5 as double) as flow_duration",
        *headers,
    )


RAW_FLOWS_SQL = (
    f"flows as (select event_id as flow_id, ts, {RAW_LABEL} as label_raw, "
    + ", ".join(f"{dirty_feature(k)} as {f}" for k, f in enumerate(FEATURES))
    + " from events)"
)


def clean_sql(expr: str) -> str:
    return f"case when {expr} is null or isnan({expr}) or isinf({expr}) then 0::double else {expr} end"


CLEAN_FLOWS_SQL = (
    RAW_FLOWS_SQL
    + ", clean as (select flow_id, ts, label_raw, "
    + ", ".join(f"{clean_sql(f)} as {f}" for f in FEATURES)
    + " from flows)"
)


def dirty_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbers under canonical names, not yet cleaned."""
    return _events_with_remainders(spark, sf_dir).selectExpr(
        "event_id as flow_id",
        *[f"{_by_remainder(dirty_feature(k))} as {f}" for k, f in enumerate(FEATURES)],
    )


def text_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything as text, the way a CSV reader delivers it."""
    headers = [
        f"{_by_remainder(text_feature(k))} as `{h}`" for k, h in enumerate(FEATURE_HEADERS.values())
    ]
    return _events_with_remainders(spark, sf_dir).selectExpr(
        "cast(event_id as string) as flow_id",
        "case when event_id % 4 = 0 then '' else cast(ts as string) end as Timestamp",
        "case when event_id % 4 = 0 then concat('t', cast(event_id as string)) end as time",
        f"case when event_id % 5 = 0 then null else {SRC_IP} end as src_ip",
        "case when event_id % 10 = 0 then '1.2.3.4' end as `Source IP`",
        f"{DST_IP} as `Dst IP`",
        "case when event_id % 6 = 0 then 'x' else cast(event_id % 65536 as string) end as `Source Port`",
        "cast(user_id as string) as dst_port",
        "case when event_id % 3 = 0 then 'UDP' when event_id % 3 = 1 then '' end as Protocol",
        *headers,
    )


IDENTITY_SQL = (
    f"case when event_id % 5 <> 0 then {SRC_IP} when event_id % 10 = 0 then '1.2.3.4' "
    f"else '0.0.0.0' end as src_ip, {DST_IP} as dst_ip, "
    "case when event_id % 6 = 0 then 0 else event_id % 65536 end as src_port, "
    "user_id as dst_port, "
    "case when event_id % 3 = 0 then 'UDP' else 'TCP' end as protocol"
)


def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with given predictions, latencies and memory samples."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "event_id as flow_id",
            "ts",
            "user_id",
            f"{SRC_IP} as src_ip",
            f"{DST_IP} as dst_ip",
            f"{Y_TRUE} as y_true",
            f"{Y_PRED} as y_pred",
            f"{PREDICTION} as prediction",
            f"{CONFIDENCE} as confidence",
            "value as latency_ms",
            f"{MEMORY} as memory_mb",
            "cast(floor(event_id / 1000) as bigint) as batch",
        )
        .withColumn("timestamp", iso_time(F.col("ts")))
    )


SCORED_SQL = (
    "scored as (select event_id as flow_id, ts, user_id, "
    f"{SRC_IP} as src_ip, {DST_IP} as dst_ip, {Y_TRUE} as y_true, {Y_PRED} as y_pred, "
    f"{PREDICTION} as prediction, {CONFIDENCE} as confidence, value as latency_ms, "
    f"{MEMORY} as memory_mb, cast(floor(event_id / 1000) as bigint) as batch, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as timestamp from events)"
)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as request_id",
        "ts",
        "user_id as client",
        "value as duration_ms",
        "event_type <> 'error' as success",
    )


REQUESTS_SQL = (
    "requests as (select event_id as request_id, ts, user_id as client, value as duration_ms, "
    "event_type <> 'error' as success from events)"
)

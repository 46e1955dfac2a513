"""Alerts built from scored flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.alerts import alert_id, severity
from packetloom.functions.labels import is_attack
from packetloom.operators.ordering import last_n
from packetloom.schemas import ATTRIBUTION


def attack_rows(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    return df.filter(is_attack(F.col(prediction)))


def build_alerts(
    scored: DataFrame,
    flow_id: str = "flow_id",
    ts: str = "ts",
    high_above: float = 0.8,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One alert per attack row.

    Attributions are taken from ``top_features`` when the rows carry it.
    """
    top = (
        F.col("top_features")
        if "top_features" in scored.columns
        else F.array().cast(T.ArrayType(ATTRIBUTION))
    )
    return attack_rows(scored).select(
        *keep,
        alert_id(F.col(flow_id), F.col(ts)).alias("id"),
        F.col("timestamp"),
        F.col("src_ip"),
        F.col("dst_ip"),
        F.col("prediction").alias("attack_type"),
        F.col("confidence"),
        top.alias("top_3_features"),
        severity(F.col("confidence"), high_above).alias("severity"),
    )


def recent_alerts(
    alerts: DataFrame, limit: int = 10, order: Sequence[str] = ("timestamp", "id")
) -> DataFrame:
    """The newest alerts, newest first."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    newest = last_n(alerts, list(order), limit)
    return newest.orderBy(*[F.col(c).desc() for c in order])


def retain_recent(df: DataFrame, ts: str = "ts", hours: int = 24) -> DataFrame:
    """Rows of the last ``hours`` before the newest row."""
    newest = df.agg(F.max(ts).alias("t")).scalar()
    return df.filter(F.col(ts) >= newest - F.make_dt_interval(hours=F.lit(hours)))

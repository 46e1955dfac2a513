"""Detection: raw rows in, events and alerts out. The same plan serves batch
tables and streams; it holds no state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.alerts import alert_id, severity
from packetloom.functions.labels import is_attack
from packetloom.operators.alerts import build_alerts
from packetloom.operators.explain import SHAPLEY, explain_alerts, explain_flows
from packetloom.operators.features import feature_map, parse_event_time, to_flows
from packetloom.operators.model import FlowModel, score_flows
from packetloom.operators.validation import validate_features


@dataclass
class Detection:
    """The frames of one detection run."""

    scored: DataFrame
    rejected: DataFrame
    model: FlowModel
    method: str = SHAPLEY

    def alerts(self, k: int = 3) -> DataFrame:
        explained = explain_alerts(self.model, self.scored, k=k, method=self.method)
        return build_alerts(explained)

    def events(self, k: int = 3) -> DataFrame:
        """Every flow as an event record; attacks carry their alert."""
        explained = explain_flows(self.model, self.scored, k=k, method=self.method)
        alert = F.struct(
            alert_id(F.col("flow_id"), F.col("ts")).alias("id"),
            "timestamp",
            "src_ip",
            "dst_ip",
            F.col("prediction").alias("attack_type"),
            "confidence",
            F.col("top_features").alias("top_3_features"),
            severity(F.col("confidence")).alias("severity"),
        )
        return explained.select(
            "timestamp",
            (F.col("latency_ms") if "latency_ms" in explained.columns else F.lit(None))
            .cast("double")
            .alias("latency_ms"),
            feature_map().alias("flow_features"),
            "src_ip",
            "dst_ip",
            F.when(is_attack(F.col("prediction")), alert).alias("alert"),
        )


def detect(
    rows: DataFrame,
    model: FlowModel,
    keep: Sequence[str] = ("flow_id",),
    method: str = SHAPLEY,
    time_formats: Sequence[str] = (),
) -> Detection:
    """Read, check and score flows. Broken rows end up in ``rejected``."""
    if "flow_id" not in [c.strip() for c in rows.columns]:
        # no id in the input: one from all that the row holds; never the clock,
        # which a repeated task would read anew
        named = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
        rows = rows.withColumn("flow_id", F.abs(F.xxhash64(named)))
        keep = [*keep, *(["flow_id"] if "flow_id" not in keep else [])]
    flows = parse_event_time(to_flows(rows, keep=keep), time_formats)
    return Detection(
        scored=score_flows(model, validate_features(flows, "valid")),
        rejected=validate_features(flows, "quarantine"),
        model=model,
        method=method,
    )

"""Event logs as JSON lines: all events, or only those with an alert."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.alerts import iso_now
from packetloom.operators.features import to_flows
from packetloom.operators.ordering import first_n
from packetloom.schemas import EVENT_SCHEMA, FEATURES


def alert_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("alert").isNotNull())


def write_events_json(events: DataFrame, path: str) -> None:
    """Append events to a log."""
    events.write.mode("append").json(path)


def write_replay_json(events: DataFrame, path: str) -> None:
    """Append the events that carry an alert."""
    write_events_json(alert_events(events), path)


def stream_events_json(events: DataFrame, path: str, checkpoint: str, alerts_only: bool = False):
    """A writer that appends a stream of events to a log; start it yourself."""
    rows = alert_events(events) if alerts_only else events
    return (
        rows.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def read_events_json(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(EVENT_SCHEMA).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            raise FileNotFoundError(f"event log not found: {path}") from error
        raise


def read_replay_json(spark: SparkSession, path: str, max_flows: int | None = None) -> DataFrame:
    """Saved events as flow records again, stamped with the current time.

    ``max_flows`` keeps the oldest events, cut from ranges of the order.
    """
    events = read_events_json(spark, path)
    if max_flows:
        events = first_n(events, ["timestamp", "src_ip", "dst_ip"], max_flows)
    flat = events.select(
        iso_now().alias("timestamp"),
        "src_ip",
        "dst_ip",
        *[F.try_element_at("flow_features", F.lit(f)).alias(f) for f in FEATURES],
    )
    return to_flows(flat)

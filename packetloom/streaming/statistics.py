"""Running statistics over endless flows, by event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.labels import is_attack
from packetloom.functions.values import ratio


def with_event_time(df: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """An event-time column with a watermark (only zoned timestamps can carry
    one)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def closing_row(rows: DataFrame, after: str, ts: str = "ts") -> DataFrame:
    """One row of the same columns, ``after`` (an interval) and a second behind the
    last of the table ``rows``; its other columns are NULL.

    Appended to a stream of those rows it moves the watermark past them: with
    ``after`` the delay and the width of a window, all their windows close. The
    row's own window stays open.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    last = rows.agg(F.max(ts).alias(ts))
    behind = (F.col(ts) + F.expr(f"interval {after}") + F.expr("interval 1 second")).cast(kinds[ts])
    return last.select(*[behind.alias(c) if c == ts else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])


def stream_stats(
    scored: DataFrame, ts: str = "ts", width: str = "1 minute", delay: str = "10 minutes"
) -> DataFrame:
    """Flows per window and category; a window is final once the watermark has
    passed it, and later rows for it are dropped."""
    seconds = F.unix_seconds(F.col("window.end")) - F.unix_seconds(F.col("window.start"))
    return (
        with_event_time(scored, ts, delay)
        .groupBy(F.window(ts, width), F.col("prediction"))
        .agg(F.count(F.lit(1)).alias("flows"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("prediction").alias("attack_type"),
            "flows",
            ratio(F.col("flows"), seconds).alias("flows_per_second"),
            F.when(is_attack(F.col("prediction")), F.col("flows")).otherwise(0).alias("alerts"),
        )
    )


def stream_totals(scored: DataFrame) -> DataFrame:
    """All-time flows per category; the state holds one row per category.
    For output mode ``complete`` or ``update``."""
    return scored.groupBy(F.col("prediction").alias("attack_type")).agg(
        F.count(F.lit(1)).alias("flows")
    )


def stream_request_metrics(
    requests: DataFrame,
    width: str = "10 seconds",
    delay: str = "1 minute",
    ts: str = "ts",
    duration: str = "duration_ms",
    success: str = "success",
    accuracy: int = 10_000,
) -> DataFrame:
    """Requests, success rate, mean and p95 latency per window.

    The p95 is a sketch: its state stays small however busy a window is.
    """
    total, good = F.count(F.lit(1)), F.count_if(F.col(success))
    return (
        with_event_time(requests, ts, delay)
        .groupBy(F.window(ts, width))
        .agg(
            total.alias("requests"),
            ratio(good, total).alias("success_rate"),
            F.avg(duration).alias("avg_ms"),
            F.percentile_approx(duration, 0.95, accuracy).alias("p95_ms"),
        )
        .select(F.col("window.start").alias("window_start"), "requests", "success_rate", "avg_ms", "p95_ms")
    )


def drop_repeats(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", delay: str = "10 minutes"
) -> DataFrame:
    """Rows seen again within the watermark delay pass only once."""
    return with_event_time(df, ts, delay).dropDuplicatesWithinWatermark(list(keys))

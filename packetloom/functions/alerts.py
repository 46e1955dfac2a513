"""Column expressions that describe scored flows and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.values import check_threshold


def severity(confidence: Column, high_above: float = 0.8) -> Column:
    """``high`` strictly above the threshold, else ``medium``."""
    return F.when(confidence > check_threshold(high_above), "high").otherwise("medium")


def argmax_index(scores: Column) -> Column:
    """0-based position of the largest entry, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def alert_id(flow_id: Column, ts: Column) -> Column:
    """An id that a rerun reproduces: no counter, no wall clock. An unreadable
    time counts as 0."""
    return F.concat(
        F.lit("alert_"),
        flow_id.cast("string"),
        F.lit("_"),
        F.coalesce(F.unix_millis(ts.cast("timestamp")), F.lit(0)).cast("string"),
    )


def short_time(timestamp: Column) -> Column:
    """Clock part of an ISO time text."""
    return F.substring(F.element_at(F.split(timestamp, "T"), -1), 1, 8)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def iso_now() -> Column:
    return iso_time(F.current_timestamp())


def uptime_text(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(whole / 3600),
        F.floor((whole % 3600) / 60),
        whole % 60,
    )


def feature_text(attributions: Column, k: int = 3) -> Column:
    """``name=value (imp=x)`` of the first ``k`` attributions."""
    return F.concat_ws(
        "; ",
        F.transform(
            F.slice(attributions, 1, k),
            lambda a: F.format_string(
                "%s=%.2f (imp=%.4f)", a["feature"], a["value"], a["abs_importance"]
            ),
        ),
    )


def top_attributions(
    values: Column, contributions: Column, names: Sequence[str], k: int = 3
) -> Column:
    """The ``k`` entries largest by absolute contribution, as structs.

    Ties go to the higher feature index.
    """
    name_list = F.array(*[F.lit(n) for n in names])
    order = F.array_sort(
        F.transform(
            contributions,
            lambda c, i: F.struct((-F.abs(c)).alias("rank"), (-i).alias("at")),
        )
    )
    return F.transform(
        F.slice(order, 1, k),
        lambda o: F.struct(
            F.get(name_list, -o["at"]).alias("feature"),
            F.get(values, -o["at"]).cast("double").alias("value"),
            F.get(contributions, -o["at"]).cast("double").alias("importance"),
            (-o["rank"]).cast("double").alias("abs_importance"),
        ),
    )

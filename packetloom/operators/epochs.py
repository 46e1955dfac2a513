"""Statistics that start anew at many moments of reset.

Each row belongs to the last reset at or before it. Rows and resets are put in one
order and the resets are counted along it by range partitions, so neither a busy
epoch nor a table without a key comes into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.labels import is_attack
from packetloom.functions.values import ratio
from packetloom.operators.ordering import running_totals, with_rank


def _moments(df: DataFrame, ts: str, resets: DataFrame, moment: str) -> DataFrame:
    kind = df.schema[ts].dataType
    return resets.select(F.col(moment).cast(kind).alias("_at")).filter("_at is not null").distinct()


def with_epoch(df: DataFrame, ts: str, resets: DataFrame, moment: str) -> DataFrame:
    """The rows with ``epoch``: the resets at or before ``ts``, 0 ahead of the first.

    A reset that is given twice counts once, NULL resets do not count, and rows
    without a time have a NULL epoch.
    """
    one = F.lit(1).cast("bigint")
    marks = _moments(df, ts, resets, moment).select("_at", F.lit(0).alias("_kind"), one.alias("_mark"))
    rows = df.select(
        F.col(ts).alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit(0).cast("bigint").alias("_mark"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
    )
    both = rows.unionByName(marks, allowMissingColumns=True)
    counted = running_totals(both, {"epoch": F.col("_mark")}, ["_at", "_kind"])
    epoch = F.when(F.col("_at").isNotNull(), F.col("epoch")).alias("epoch")
    return counted.filter("_kind = 1").select("_row.*", epoch)


def epoch_stats(
    df: DataFrame,
    ts: str,
    resets: DataFrame,
    moment: str,
    prediction: str = "prediction",
    latency: str = "latency_ms",
) -> DataFrame:
    """Flows, attacks, mean latency and rate of each epoch with its ``epoch_start``.

    Every reset has a row, with zeros if no flow followed it; epoch 0 has one if any
    flow came before the first reset. Flows without a time are left out.
    """
    found = with_epoch(df, ts, resets, moment).filter("epoch is not null")
    seconds = F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))
    figures = found.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.count_if(is_attack(F.col(prediction))).alias("attack_flows"),
        F.avg(latency).alias("avg_latency_ms"),
        (seconds / 1_000_000).alias("seconds"),
    )
    starts = with_rank(_moments(df, ts, resets, moment), ["_at"], name="epoch")
    every = starts.withColumnRenamed("_at", "epoch_start").join(figures, "epoch", "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total_flows", "attack_flows", "avg_latency_ms", "seconds")}
    return every.withColumns(zero).withColumn(
        "flows_per_second", ratio(F.col("total_flows"), F.col("seconds"))
    )

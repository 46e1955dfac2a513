"""Traffic, request and latency statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.labels import is_attack
from packetloom.functions.values import epoch_seconds, ratio
from packetloom.operators.evaluation import classification_metrics
from packetloom.operators.features import settled
from packetloom.operators.ordering import last_n, running_totals, with_rank
from packetloom.operators.percentiles import LINEAR, RANK, exact_percentiles, percentile_name
from packetloom.schemas import TARGETS
from packetloom.session import written

#: sizes of the history buffers of a serving process, for ``keep`` and ``buffer``
KEPT_SAMPLES = 10_000
ALERT_BUFFER = 1_000


def _zero(column: Column) -> Column:
    return F.coalesce(column.cast("double"), F.lit(0.0))


def _span_seconds(ts: str) -> Column:
    t = epoch_seconds(F.col(ts))
    return F.greatest(F.coalesce(F.max(t) - F.min(t), F.lit(0.0)), F.lit(0.0))


def _as_struct(one_row: DataFrame) -> Column:
    """A one-row frame as a single struct value of another query."""
    return one_row.select(F.struct(*one_row.columns)).scalar()


def _counts_map(counts: DataFrame, key: str, count: str = "count") -> DataFrame:
    """A frame with one row per category as one row with a sorted map."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(count))))
    return counts.agg(F.map_from_entries(pairs).alias("counts"))


# --- distributions ----------------------------------------------------------


def attack_distribution(
    df: DataFrame, prediction: str = "prediction", include_normal: bool = True
) -> DataFrame:
    """Rows per predicted category."""
    rows = df if include_normal else df.filter(is_attack(F.col(prediction)))
    return rows.groupBy(F.col(prediction).alias("attack_type")).agg(
        F.count(F.lit(1)).alias("count")
    )


def attack_rate(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Percent of rows that are attacks; 0 for an empty table."""
    attacks = F.count_if(is_attack(F.col(prediction)))
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.agg((attacks / total * 100).alias("attack_rate"))


# --- latency and requests ---------------------------------------------------


def non_negative(df: DataFrame, value: str) -> DataFrame:
    """Drop negative (and missing) samples."""
    return df.filter(F.col(value) >= 0)


def latency_stats(df: DataFrame, value: str) -> DataFrame:
    """Linear p50/p95/p99, mean, population deviation, max and sample count."""
    samples = non_negative(df, value)
    also = {
        "mean": _zero(F.avg(value)),
        "std": _zero(F.stddev_pop(value)),
        "max": _zero(F.max(value)),
        "samples": F.count(F.lit(1)),
    }
    return exact_percentiles(samples, value, (0.5, 0.95, 0.99), LINEAR, also=also)


def percentile(df: DataFrame, value: str, p: float) -> DataFrame:
    """One linear percentile, ``p`` in 0..100; 0 for an empty table."""
    name = percentile_name(p / 100)
    out = exact_percentiles(df, value, (p / 100,), LINEAR)
    return out.select(F.col(name).alias("percentile"))


def gauge_summary(df: DataFrame, value: str) -> DataFrame:
    """Peak and mean of a gauge; negative samples do not count."""
    return non_negative(df, value).agg(
        _zero(F.max(value)).alias("peak"),
        _zero(F.avg(value)).alias("mean"),
        F.count(F.lit(1)).alias("samples"),
    )


def request_stats(
    df: DataFrame,
    ts: str = "ts",
    duration: str = "duration_ms",
    success: str = "success",
    keep: int | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Serving metrics in one row.

    Rank percentiles cover all requests, or the newest ``keep`` if given; counts, mean, min and max always cover all of them.
    """
    total = F.count(F.lit(1))
    good = F.count_if(F.col(success))
    also = {
        "total_requests": total,
        "successful_requests": good,
        "failed_requests": total - good,
        "success_rate": ratio(good, total),
        "avg_ms": _zero(F.avg(duration)),
        "min_ms": _zero(F.min(duration)),
        "max_ms": _zero(F.max(duration)),
        "uptime_seconds": _span_seconds(ts),
    }
    ps = ("p50", "p95", "p99")
    if keep is None:
        out = exact_percentiles(df, duration, (0.5, 0.95, 0.99), RANK, also=also)
    else:
        order = list(order or [ts])
        recent = last_n(df.select(*dict.fromkeys([*order, duration])), order, keep)
        ranks = _as_struct(exact_percentiles(recent, duration, (0.5, 0.95, 0.99), RANK))
        out = df.agg(*[c.alias(k) for k, c in also.items()]).withColumn("_r", ranks)
        out = out.select(*also, "_r.*")
    return out.select(*also, *[F.col(p).alias(f"{p}_ms") for p in ps])


def traffic_stats(
    df: DataFrame,
    order: Sequence[str],
    prediction: str = "prediction",
    latency: str = "latency_ms",
    keep: int | None = None,
    buffer: int | None = None,
) -> DataFrame:
    """Pipeline statistics in one row: totals over the table, latency figures
    over all rows or the newest ``keep``, distribution with Normal. A buffer of
    pending alerts holds at most ``buffer`` of them, if given."""
    counts = attack_distribution(df, prediction)
    recent = df.select(*order, latency)
    if keep is not None:
        recent = last_n(recent, order, keep)
    newest = _as_struct(
        recent.agg(
            _zero(F.avg(latency)).alias("avg"),
            _zero(F.max_by(latency, F.struct(*order))).alias("latest"),
        )
    )
    p95 = exact_percentiles(recent, latency, (0.95,), RANK).scalar()
    attacks = F.coalesce(F.sum(F.when(is_attack(F.col("attack_type")), F.col("count"))), F.lit(0))
    total = F.coalesce(F.sum("count"), F.lit(0))
    pairs = F.array_sort(F.collect_list(F.struct("attack_type", "count")))
    out = counts.agg(
        total.alias("total_flows"),
        (total - attacks).alias("normal_flows"),
        attacks.alias("attack_flows"),
        F.map_from_entries(pairs).alias("attack_distribution"),
        (attacks if buffer is None else F.least(attacks, F.lit(buffer))).alias("pending_alerts"),
    )
    return out.withColumn("_n", newest).select(
        *out.columns,
        F.col("_n.avg").alias("avg_inference_time_ms"),
        F.col("_n.latest").alias("latest_inference_time_ms"),
        p95.alias("p95_inference_time_ms"),
    )


def since(df: DataFrame, ts: str, reset: datetime | str | Column) -> DataFrame:
    """Rows after a reset; statistics over them start anew."""
    moment = reset if isinstance(reset, Column) else F.lit(reset)
    return df.filter(F.col(ts) >= moment.cast(df.schema[ts].dataType))


# --- throughput -------------------------------------------------------------


def throughput(df: DataFrame, ts: str) -> DataFrame:
    """Rows per second of the covered time; 0 when no time passed."""
    return df.agg(ratio(F.count(F.lit(1)), _span_seconds(ts)).alias("throughput_fps"))


def mean_batch_throughput(
    df: DataFrame, batch: str | Sequence[str], seconds: Column
) -> DataFrame:
    """Mean over batches of rows per second; batches without time are left out."""
    keys = [batch] if isinstance(batch, str) else list(batch)
    batches = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), seconds.alias("seconds"))
    return batches.filter(F.col("seconds") > 0).agg(
        _zero(F.avg(F.col("rows") / F.col("seconds"))).alias("throughput_fps")
    )


def stream_rates(df: DataFrame, ts: str, prediction: str = "prediction") -> DataFrame:
    """Flows and alerts per second over the covered time."""
    elapsed = _span_seconds(ts)
    return df.agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.count_if(is_attack(F.col(prediction))).alias("alerts"),
        elapsed.alias("elapsed_seconds"),
    ).select(
        "*",
        ratio(F.col("total_flows"), F.col("elapsed_seconds")).alias("flows_per_second"),
        ratio(F.col("alerts"), F.col("elapsed_seconds")).alias("alert_rate"),
    )


# --- shapes over value and time ---------------------------------------------


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins from the minimum to the maximum, empty bins
    included."""
    values = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    ends = _as_struct(values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    low, high = F.col("_e.lo"), F.col("_e.hi")
    width = (high - low) / F.lit(bins)
    at = F.coalesce(F.floor(F.try_divide(F.col("v") - low, width)), F.lit(0))
    counts = values.withColumn("_e", ends).groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    # both sides hold at most ``bins`` rows
    return every.join(counts, "bin", "left").withColumn("_e", ends).select(
        "bin",
        (low + width * F.col("bin")).alias("bin_start"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
    )


def cumulative_timeline(
    df: DataFrame, order: Sequence[str], prediction: str = "prediction"
) -> DataFrame:
    """Running flow and attack totals at every row."""
    attack = is_attack(F.col(prediction)).cast("bigint")
    return running_totals(
        df, {"total": F.lit(1).cast("bigint"), "attacks": F.coalesce(attack, F.lit(0))}, order
    )


def bucketed_timeline(
    df: DataFrame, ts: str, width: str = "1 hour", prediction: str = "prediction"
) -> DataFrame:
    """Running totals at the end of every time bucket: shuffles only buckets."""
    buckets = df.groupBy(F.window(ts, width)["start"].alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_attack(F.col(prediction))).alias("a"),
    )
    out = running_totals(buckets, {"total": F.col("n"), "attacks": F.col("a")}, ["bucket"])
    return out.select("bucket", "total", "attacks")


def batch_counts(df: DataFrame, size: int) -> DataFrame:
    """Number and length of the consecutive batches of ``size`` rows.

    Every batch but the last is full, so the row count alone decides.
    """
    if size < 1:
        raise ValueError("batch size must be positive")
    n = df.count()
    batches = -(-n // size)
    return df.sparkSession.range(batches).select(
        F.col("id").alias("batch"),
        F.least(F.lit(size).cast("bigint"), F.lit(n) - F.col("id") * size).alias("rows"),
    )


def with_batch(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Number rows into consecutive batches of ``size`` along an order."""
    ranked = with_rank(df, order, name="_rank")
    return ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / size)).drop("_rank")


# --- reports ----------------------------------------------------------------


def target_status(
    metrics: DataFrame,
    p95: str = "p95_latency_ms",
    fpr: str = "fpr",
    fps: str = "throughput_fps",
    f1: str = "f1_macro",
    targets: Mapping[str, float] = TARGETS,
) -> DataFrame:
    """Which production targets a row of metrics meets."""
    passed = {
        "p95_latency_ok": _zero(F.col(p95)) < targets["p95_latency_ms"],
        "fpr_ok": _zero(F.col(fpr)) < targets["fpr"],
        "throughput_ok": _zero(F.col(fps)) >= targets["throughput_fps"],
        "f1_macro_ok": _zero(F.col(f1)) >= targets["f1_macro"],
    }
    out = metrics.select("*", *[c.alias(n) for n, c in passed.items()])
    # the overall verdict looks at speed and false alarms, not at F1
    return out.withColumn(
        "meets_targets", F.col("p95_latency_ok") & F.col("fpr_ok") & F.col("throughput_ok")
    )


def metrics_long(stats: DataFrame, attacks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Gauges as (name, label, value) rows: scalars, then attacks by type."""
    scalars = stats.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        [], list(names), "name", "value"
    )
    by_type = attacks.select(
        F.lit("attacks_detected").alias("name"),
        F.col("attack_type").alias("label"),
        F.col("count").cast("double").alias("value"),
    )
    return scalars.select("name", F.lit("").alias("label"), "value").unionByName(by_type)


def evaluation_report(
    df: DataFrame,
    y_true: str = "y_true",
    y_pred: str = "y_pred",
    prediction: str = "prediction",
    latency: str = "latency_ms",
    batch: str | Sequence[str] = "batch",
    seconds: Column | None = None,
    memory: str | None = None,
) -> DataFrame:
    """The evaluation of a scored table in one row: latency, throughput,
    quality, memory, distribution and target status.

    The source is read once: the columns that count are written, and the figures
    come from those. ``seconds`` may use only the columns named here.
    """
    keys = [batch] if isinstance(batch, str) else list(batch)
    used = dict.fromkeys([y_true, y_pred, prediction, latency, *keys, *([memory] if memory else [])])
    df = written(df.select(*used), "report")
    seconds = seconds if seconds is not None else F.sum(F.col(latency)) / 1000
    speed = mean_batch_throughput(df, batch, seconds).scalar()
    quality = _as_struct(classification_metrics(df, y_true, y_pred))
    types = _counts_map(attack_distribution(df, prediction), "attack_type").scalar()
    out = latency_stats(df, latency).select(
        F.struct(
            F.col("p50").alias("p50_ms"),
            F.col("p95").alias("p95_ms"),
            F.col("p99").alias("p99_ms"),
            F.col("mean").alias("mean_ms"),
            F.col("max").alias("max_ms"),
        ).alias("latency_metrics"),
        F.col("samples").alias("rows_processed"),
        speed.alias("throughput_fps"),
        quality.alias("accuracy_metrics"),
        types.alias("attack_distribution"),
    )
    out = settled(out, {c: F.col(c) for c in out.columns})
    if memory:
        gauge = _as_struct(gauge_summary(df, memory).select("peak", "mean"))
        out = out.withColumn("memory_metrics", gauge)
    flat = out.select(
        "*",
        F.col("latency_metrics.p95_ms").alias("p95_latency_ms"),
        F.col("accuracy_metrics.fpr").alias("fpr"),
        F.col("accuracy_metrics.f1_macro").alias("f1_macro"),
    )
    return target_status(flat).drop("p95_latency_ms", "f1_macro")


def summary(
    df: DataFrame,
    ts: str,
    latency: str,
    memory: str,
    y_true: str,
    y_pred: str,
    prediction: str = "prediction",
) -> DataFrame:
    """The nested stress-test record of a scored table, one row. The source is
    read once, as in ``evaluation_report``."""
    used = dict.fromkeys([ts, latency, memory, y_true, y_pred, prediction])
    df = written(df.select(*used), "summary")
    lat = latency_stats(df, latency)
    rates = _as_struct(
        df.agg(
            F.count(F.lit(1)).alias("total_flows"),
            _span_seconds(ts).alias("duration_seconds"),
        ).select(
            ratio(F.col("total_flows"), F.col("duration_seconds")).alias("flows_per_second"),
            "total_flows",
            "duration_seconds",
        )
    )
    return lat.select(
        F.struct(
            *[F.col(c).alias(f"{c}_ms") for c in ("p50", "p95", "p99", "mean", "std")],
            F.col("samples"),
        ).alias("latency"),
        rates.alias("throughput"),
        _as_struct(classification_metrics(df, y_true, y_pred)).alias("accuracy"),
        _as_struct(gauge_summary(df, memory)).alias("memory"),
        _counts_map(attack_distribution(df, prediction), "attack_type")
        .scalar()
        .alias("attack_distribution"),
    )



"""Queries on stored sketches, on alerts kept by day, and on statistics between resets."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from packetloom.catalog.bindings import SCORED_SQL, scored_flows
from packetloom.catalog.registry import query, rounded
from packetloom.operators.epochs import epoch_stats, with_epoch
from packetloom.operators.sketches import (
    RANK_ERROR,
    read_sketches,
    rolled_up,
    sketch_percentile,
    sketched,
    write_sketches,
)
from packetloom.session import scratch_path
from packetloom.streaming.sinks import drop_days, read_days, write_by_day


def _hours(spark, d):
    path = scratch_path(spark, "sketches")
    write_sketches(sketched(scored_flows(spark, d), "latency_ms", "ts", ["prediction"]), path)
    return read_sketches(spark, path)


def _near(flows, merged, by):
    """``merged`` with whether its p50, p95 and p99 hold ranks within the bound: the rows
    below and up to each value are counted, no group is ordered."""
    ps = {f"p{round(100 * p)}": p for p in (0.5, 0.95, 0.99)}
    values = merged.withColumns({n: sketch_percentile(p) for n, p in ps.items()}).drop("sketch")
    met = flows.select(*by, "latency_ms").join(values, by)
    counts = met.groupBy(*by, *values.drop(*by).columns).agg(
        *[F.count_if(F.col("latency_ms") < F.col(n)).alias(f"{n}_below") for n in ps],
        *[F.count_if(F.col("latency_ms") <= F.col(n)).alias(f"{n}_upto") for n in ps],
    )
    near = [
        (F.col(f"{n}_below") <= (p + RANK_ERROR) * F.col("n")) & (F.col(f"{n}_upto") >= (p - RANK_ERROR) * F.col("n"))
        for n, p in ps.items()
    ]
    return counts.select(
        *by, "n", (F.col("total") / F.col("n")).alias("avg_ms"), F.col("least").alias("min_ms"),
        F.col("most").alias("max_ms"), *[c.alias(f"{n}_is_near") for n, c in zip(ps, near)],
    )


_FIGURES = (
    "count(latency_ms) as n, round(avg(latency_ms), 6) as avg_ms, round(min(latency_ms), 6) as min_ms, "
    "round(max(latency_ms), 6) as max_ms, true as p50_is_near, true as p95_is_near, true as p99_is_near"
)


@query(
    "e7_sketches_by_day_and_class",
    f"with {SCORED_SQL} select cast(ts as date) as day, prediction, {_FIGURES} from scored "
    "where latency_ms is not null group by 1, 2",
)
def _(spark, d):
    days = rolled_up(_hours(spark, d), [F.to_date("start").alias("day"), "prediction"])
    flows = scored_flows(spark, d).withColumn("day", F.to_date("ts")).filter("latency_ms is not null")
    return rounded(_near(flows, days, ["day", "prediction"]))


@query(
    "e6_sketches_whole_span_by_class",
    f"with {SCORED_SQL} select prediction, {_FIGURES} from scored where latency_ms is not null group by 1",
)
def _(spark, d):
    merged = rolled_up(_hours(spark, d), ["prediction"])
    return rounded(_near(scored_flows(spark, d).filter("latency_ms is not null"), merged, ["prediction"]))


@query(
    "k8_days_dropped",
    f"with {SCORED_SQL} select flow_id, prediction, cast(ts as date) as day from scored where prediction <> 'Normal' "
    "and cast(ts as date) >= (select cast(max(ts) as date) - 7 from scored)",
)
def _(spark, d):
    alerts = scored_flows(spark, d).filter("prediction <> 'Normal'").select("flow_id", "prediction", "ts")
    path = scratch_path(spark, "alerts-by-day")
    write_by_day(alerts, path)
    last = scored_flows(spark, d).agg(F.max(F.to_date("ts"))).first()[0]
    if last is not None:
        drop_days(spark, path, last - timedelta(days=7))
    return read_days(spark, path).select("flow_id", "prediction", "day")


#: every moment of a flow whose id is a multiple of 97 is a reset
_RESETS = "flow_id % 97 = 0"


@query(
    "e25_rows_by_reset",
    f"with {SCORED_SQL}, r as (select distinct ts from scored where {_RESETS}) "
    "select s.flow_id, count(r.ts) as epoch from scored s left join r on r.ts <= s.ts group by 1",
)
def _(spark, d):
    flows = scored_flows(spark, d)
    return with_epoch(flows, "ts", flows.filter(_RESETS), "ts").select("flow_id", "epoch")


@query(
    "e25_stats_per_reset",
    f"with {SCORED_SQL}, r as (select ts as epoch_start, row_number() over (order by ts) as epoch from "
    f"(select distinct ts from scored where {_RESETS})), "
    "j as (select s.*, r.epoch_start, coalesce(r.epoch, 0) as epoch from scored s "
    "asof left join r on r.epoch_start <= s.ts), "
    "g as (select epoch, epoch_start, count(*) as total_flows, count(*) filter (prediction <> 'Normal') "
    "as attack_flows, avg(latency_ms) as a, epoch_us(max(ts)) - epoch_us(min(ts)) as us from j group by 1, 2) "
    "select epoch, epoch_start, total_flows, attack_flows, round(coalesce(a, 0), 6) as avg_latency_ms, "
    "round(us / 1000000.0::double, 6) as seconds, "
    "round(case when us > 0 then total_flows / (us / 1000000.0::double) else 0 end, 6) as flows_per_second from g",
)
def _(spark, d):
    flows = scored_flows(spark, d)
    return rounded(epoch_stats(flows, "ts", flows.filter(_RESETS), "ts"))

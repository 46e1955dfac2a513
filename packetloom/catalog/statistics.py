"""Queries over class statistics, quality, traffic, requests and latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog.bindings import (
    REQUESTS_SQL,
    SCORED_SQL,
    requests,
    scored_flows,
    table,
)
from packetloom.catalog.registry import query, rounded
from packetloom.operators import evaluation as E
from packetloom.operators import statistics as S
from packetloom.operators.percentiles import RANK, approx_percentile, exact_percentiles
from packetloom.schemas import LABELS

_SPAN = "greatest(epoch_us(max(ts)) - epoch_us(min(ts)), 0) / 1000000"


def _rank_sql(source: str, value: str, p: float, keep: str = "") -> str:
    """Element floor(n * p) of the sorted values (scalar subquery)."""
    rows = f"(select {value} as v from {source} {keep})"
    return (
        f"(select v from (select v, row_number() over (order by v) as rn, count(*) over () as n from {rows}) "
        f"where rn = least(cast(floor(n * {p}::double) as bigint) + 1, n))"
    )


# --- classes ----------------------------------------------------------------


@query(
    "e1_class_distribution",
    "select o_orderpriority, count(*) as count, round(count(*) * 100.0::double / (select count(*) from orders), 6) "
    "as percent from orders group by 1",
)
def _(spark, d):
    return rounded(E.class_distribution(table(spark, d, "orders"), "o_orderpriority"))


@query(
    "e2_imbalance_ratio",
    "select round(max(n)::double / min(n), 6) as imbalance_ratio from "
    "(select count(*) as n from customer group by c_mktsegment)",
)
def _(spark, d):
    return rounded(E.imbalance_ratio(table(spark, d, "customer"), "c_mktsegment"))


@query(
    "e3_balanced_weights",
    "select c_custkey, c_mktsegment, round((select count(*) from customer)::double / "
    "((select count(distinct c_mktsegment) from customer) * count(*) over (partition by c_mktsegment)), 6) "
    "as weight from customer",
)
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return rounded(E.balanced_weights(rows, "c_mktsegment"))


@query(
    "e23_distinct_classes",
    f"with {SCORED_SQL} select y_pred, count(*) as count from scored group by 1",
)
def _(spark, d):
    return E.class_counts(scored_flows(spark, d), "y_pred")


@query(
    "h2_class_union",
    f"with {SCORED_SQL} select y_true as class from scored union select y_pred from scored",
)
def _(spark, d):
    return E.class_set(scored_flows(spark, d), "y_true", "y_pred")


# --- quality ----------------------------------------------------------------

_PER_CLASS = """
conf as (select {t} as t, {p} as p, count(*) as n from {src} group by 1, 2),
classes as (select t as c from conf union select p from conf),
per_class as (
  select c,
    coalesce((select sum(n) from conf where t = c and p = c), 0)::double as tp,
    coalesce((select sum(n) from conf where t = c), 0)::double as support,
    coalesce((select sum(n) from conf where p = c), 0)::double as predicted
  from classes),
scores as (
  select c, support,
    coalesce(tp / nullif(predicted, 0), 0) as precision,
    coalesce(tp / nullif(support, 0), 0) as recall,
    coalesce(2 * tp / nullif(support + predicted, 0), 0) as f1, tp
  from per_class)"""
_QUALITY = (
    "round(sum(tp) / sum(support), 6) as accuracy, round(avg(precision), 6) as precision_macro, "
    "round(avg(recall), 6) as recall_macro, round(avg(f1), 6) as f1_macro, "
    "round(coalesce(sum(case when c = 0 then support - tp end) / nullif(sum(case when c = 0 then support end), 0), 0), 6) as fpr"
)
_SCORED_CLASSES = SCORED_SQL + "," + _PER_CLASS.format(t="y_true", p="y_pred", src="scored")


@query(
    "e11_false_positive_rate",
    f"with {SCORED_SQL} select round(count(*) filter (y_true = 0 and y_pred <> 0)::double / "
    "count(*) filter (y_true = 0), 6) as fpr from scored",
)
def _(spark, d):
    return rounded(E.false_positive_rate(scored_flows(spark, d), "y_true", "y_pred"))


@query("e12_classification_metrics", f"with {_SCORED_CLASSES} select {_QUALITY} from scores")
def _(spark, d):
    return rounded(E.classification_metrics(scored_flows(spark, d), "y_true", "y_pred"))


@query(
    "e12_metrics_on_labels",
    "with" + _PER_CLASS.format(t="quality", p="toxic", src="labels") + f" select {_QUALITY} from scores",
)
def _(spark, d):
    return rounded(E.classification_metrics(table(spark, d, "labels"), "quality", "toxic"))


@query(
    "e13_classification_report",
    f"with {_SCORED_CLASSES}, dim(class, label) as (values "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(LABELS))
    + ") select class, label, round(coalesce(precision, 0), 6) as precision, round(coalesce(recall, 0), 6) as recall, "
    "round(coalesce(f1, 0), 6) as f1, cast(coalesce(support, 0) as bigint) as support "
    "from dim left join scores on class = c",
)
def _(spark, d):
    return rounded(E.classification_report(scored_flows(spark, d), "y_true", "y_pred"))


@query(
    "e13_report_absent_classes",
    "with"
    + _PER_CLASS.format(t="quality", p="toxic", src="labels")
    + ", dim(class, label) as (values "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(LABELS))
    + ") select class, label, round(coalesce(precision, 0), 6) as precision, round(coalesce(recall, 0), 6) as recall, "
    "round(coalesce(f1, 0), 6) as f1, cast(coalesce(support, 0) as bigint) as support "
    "from dim left join scores on class = c",
)
def _(spark, d):
    return rounded(E.classification_report(table(spark, d, "labels"), "quality", "toxic"))


@query(
    "e14_confusion_matrix",
    f"with {SCORED_SQL} select y_true, "
    + ", ".join(f"count(*) filter (y_pred = {i}) as pred_{i}" for i in range(5))
    + ", count(*) filter (y_pred is null or y_pred not between 0 and 4) as pred_other from scored group by 1",
)
def _(spark, d):
    return E.confusion_matrix(scored_flows(spark, d), "y_true", "y_pred")


# --- distributions ----------------------------------------------------------


@query(
    "e10_attack_distribution",
    f"with {SCORED_SQL} select prediction as attack_type, count(*) as count from scored group by 1",
)
def _(spark, d):
    return S.attack_distribution(scored_flows(spark, d))


@query(
    "e10_alert_distribution",
    f"with {SCORED_SQL} select prediction as attack_type, count(*) as count from scored "
    "where prediction <> 'Normal' group by 1",
)
def _(spark, d):
    return S.attack_distribution(scored_flows(spark, d), include_normal=False)


@query(
    "e19_attack_rate",
    f"with {SCORED_SQL} select round(count(*) filter (prediction <> 'Normal') * 100.0::double / "
    "greatest(count(*), 1), 6) as attack_rate from scored",
)
def _(spark, d):
    return rounded(S.attack_rate(scored_flows(spark, d)))


# --- latency and requests ---------------------------------------------------


_TRAFFIC_KEEP = 5000


def _traffic_sql(recent: str, alerts: str) -> str:
    return (
        f"with {SCORED_SQL}, recent as (select * from scored {recent}), "
        "counts as (select prediction, count(*) as n from scored group by 1) "
        "select cast((select sum(n) from counts) as bigint) as total_flows, "
        "cast((select sum(n) from counts where prediction = 'Normal') as bigint) as normal_flows, "
        "cast((select sum(n) from counts where prediction <> 'Normal') as bigint) as attack_flows, "
        "(select string_agg(concat(prediction, ':', n), ',' order by prediction) from counts) as attack_distribution, "
        f"cast({alerts} as bigint) as pending_alerts, "
        "(select round(avg(latency_ms), 6) from recent) as avg_inference_time_ms, "
        "(select arg_max(latency_ms, ts) from recent) as latest_inference_time_ms, "
        + _rank_sql("recent", "latency_ms", 0.95)
        + " as p95_inference_time_ms"
    )


def _traffic(stats):
    pairs = F.transform(
        F.map_entries("attack_distribution"), lambda e: F.concat_ws(":", e["key"], e["value"])
    )
    return rounded(stats.withColumn("attack_distribution", F.array_join(pairs, ",")))


_ATTACKS = "(select sum(n) from counts where prediction <> 'Normal')"


@query(
    "e4_traffic_stats",
    _traffic_sql(f"order by ts desc, flow_id desc limit {_TRAFFIC_KEEP}", f"least({_ATTACKS}, 1000)"),
)
def _(spark, d):
    order = ["ts", "flow_id"]
    return _traffic(S.traffic_stats(scored_flows(spark, d), order, keep=_TRAFFIC_KEEP, buffer=1000))


@query("e4_traffic_stats_whole_history", _traffic_sql("", _ATTACKS))
def _(spark, d):
    return _traffic(S.traffic_stats(scored_flows(spark, d), ["ts", "flow_id"]))


def _request_sql(keep: str) -> str:
    return (
        f"with {REQUESTS_SQL}, kept as (select * from requests {keep}) "
        "select count(*) as total_requests, count(*) filter (success) as successful_requests, "
        "count(*) filter (not success) as failed_requests, "
        "round(count(*) filter (success)::double / count(*), 6) as success_rate, "
        "round(avg(duration_ms), 6) as avg_ms, min(duration_ms) as min_ms, max(duration_ms) as max_ms, "
        f"round({_SPAN}, 6) as uptime_seconds, "
        + ", ".join(
            f"{_rank_sql('kept', 'duration_ms', p)} as p{int(p * 100)}_ms" for p in (0.5, 0.95, 0.99)
        )
        + " from requests"
    )


@query("e5_request_stats", _request_sql("order by ts desc, request_id desc limit 700"))
def _(spark, d):
    return rounded(S.request_stats(requests(spark, d), keep=700, order=["ts", "request_id"]))


@query("e5_request_stats_whole_history", _request_sql(""))
def _(spark, d):
    return rounded(S.request_stats(requests(spark, d), keep=None))


_LATENCY = (
    "round(quantile_cont({v}, 0.5), 6) as p50, round(quantile_cont({v}, 0.95), 6) as p95, "
    "round(quantile_cont({v}, 0.99), 6) as p99, round(avg({v}), 6) as mean, "
    "round(stddev_pop({v}), 6) as std, round(max({v}), 6) as max, count(*) as samples"
)


@query(
    "e6_latency_stats",
    f"with {SCORED_SQL} select {_LATENCY.format(v='latency_ms')} from scored where latency_ms >= 0",
)
def _(spark, d):
    return rounded(S.latency_stats(scored_flows(spark, d), "latency_ms"))


@query(
    "e6_quantity_stats",
    f"select {_LATENCY.format(v='l_quantity')} from lineitem where l_quantity >= 0",
)
def _(spark, d):
    # 50 distinct values: heavy ties at every percentile
    return rounded(S.latency_stats(table(spark, d, "lineitem"), "l_quantity"))


@query(
    "e7_percentile",
    "select round(quantile_cont(l_extendedprice, 0.9), 6) as percentile from lineitem",
)
def _(spark, d):
    return rounded(S.percentile(table(spark, d, "lineitem"), "l_extendedprice", 90))


@query(
    "e7_rank_percentiles",
    "select " + ", ".join(
        f"{_rank_sql('orders', 'o_totalprice', p)} as p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9)
    ),
)
def _(spark, d):
    return exact_percentiles(
        table(spark, d, "orders"), "o_totalprice", (0.25, 0.5, 0.75, 0.9), RANK
    )


@query(
    "e15_gauge_summary",
    f"with {SCORED_SQL} select round(max(memory_mb), 6) as peak, round(avg(memory_mb), 6) as mean, "
    "count(*) as samples from scored where memory_mb >= 0",
)
def _(spark, d):
    return rounded(S.gauge_summary(scored_flows(spark, d), "memory_mb"))


@query(
    "e16_histogram",
    "with b as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi, "
    "(max(l_extendedprice) - min(l_extendedprice)) / 50 as w from lineitem), "
    "c as (select least(cast(floor((l_extendedprice - lo) / w) as int), 49) as bin, count(*) as n "
    "from lineitem, b group by 1) "
    "select cast(i as int) as bin, round(lo + w * i, 6) as bin_start, coalesce(n, 0) as count "
    "from range(50) r(i) cross join b left join c on c.bin = i",
)
def _(spark, d):
    return rounded(S.histogram(table(spark, d, "lineitem"), "l_extendedprice", 50))


# --- throughput -------------------------------------------------------------


@query(
    "e8_throughput",
    f"with {SCORED_SQL} select round(count(*) / ({_SPAN}), 9) as throughput_fps from scored",
)
def _(spark, d):
    return rounded(S.throughput(scored_flows(spark, d), "ts"), 9)


@query(
    "e9_mean_batch_throughput",
    f"with {SCORED_SQL}, b as (select batch, count(*) as n, sum(latency_ms) / 1000 as s from scored group by 1) "
    "select round(avg(n / s), 6) as throughput_fps from b where s > 0",
)
def _(spark, d):
    scored = scored_flows(spark, d)
    return rounded(S.mean_batch_throughput(scored, "batch", F.sum("latency_ms") / 1000))


@query(
    "e20_stream_rates",
    f"with {SCORED_SQL} select count(*) as total_flows, count(*) filter (prediction <> 'Normal') as alerts, "
    f"round({_SPAN}, 6) as elapsed_seconds, round(count(*) / ({_SPAN}), 6) as flows_per_second, "
    f"round(count(*) filter (prediction <> 'Normal') / ({_SPAN}), 6) as alert_rate from scored",
)
def _(spark, d):
    return rounded(S.stream_rates(scored_flows(spark, d), "ts"))


@query(
    "e24_batch_counts",
    "with n as (select count(*) as n from lineitem) select cast(i as bigint) as batch, "
    "cast(least(777, n - i * 777) as bigint) as rows from n, range((select cast(ceil(n / 777.0) as bigint) from n)) r(i)",
)
def _(spark, d):
    return S.batch_counts(table(spark, d, "lineitem"), 777)


@query(
    "e24_rows_with_batch",
    "select event_id, cast((row_number() over (order by ts, event_id) - 1) // 333 as bigint) as batch from events",
)
def _(spark, d):
    return S.with_batch(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 333).select(
        "event_id", "batch"
    )


@query(
    "e25_since_reset",
    f"with {SCORED_SQL} select prediction as attack_type, count(*) as count from scored "
    "where ts >= timestamp '2024-01-15 00:00:00' group by 1",
)
def _(spark, d):
    kept = S.since(scored_flows(spark, d), "ts", "2024-01-15 00:00:00")
    return S.attack_distribution(kept)


# --- reports ----------------------------------------------------------------

_P95 = "quantile_cont(latency_ms, 0.95)"
_ONE_ROW = (
    f"lat as (select {_LATENCY.format(v='latency_ms')} from scored where latency_ms >= 0), "
    f"qual as (select {_QUALITY} from scores), "
    "speed as (select round(avg(n / s), 6) as throughput_fps from "
    "(select batch, count(*) as n, sum(latency_ms) / 1000 as s from scored group by 1) where s > 0), "
    "mem as (select round(max(memory_mb), 6) as peak, round(avg(memory_mb), 6) as mean_mb, count(*) as mem_n "
    "from scored where memory_mb >= 0), "
    "dist as (select string_agg(concat(prediction, ':', n), ',' order by prediction) as attack_distribution from "
    "(select prediction, count(*) as n from scored group by 1))"
)
_STATUS = (
    "p95 < 50 as p95_latency_ok, fpr < 0.02 as fpr_ok, throughput_fps >= 100000 as throughput_ok, "
    "f1_macro >= 0.97 as f1_macro_ok, (p95 < 50 and fpr < 0.02 and throughput_fps >= 100000) as meets_targets"
)


def _map_text(column):
    entries = F.transform(F.map_entries(column), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return F.array_join(entries, ",")


@query(
    "e7_approx_percentile",
    "select true as within_one_percent_of_ranks from events having count(*) > 0",
)
def _(spark, d):
    events = table(spark, d, "events")
    low, high = exact_percentiles(events, "value", (0.89, 0.91), RANK).first()
    near = approx_percentile(events, "value", 0.9)
    return near.select(F.col("p90").between(low, high).alias("within_one_percent_of_ranks"))


@query(
    "e17_target_status",
    f"with {SCORED_SQL}, per as (select y_true, {_P95} as p95, "
    "count(*) filter (y_true <> y_pred)::double / count(*) as fpr, sum(latency_ms) as throughput_fps, "
    "count(*) filter (y_true = y_pred)::double / count(*) as f1_macro from scored group by 1) "
    f"select y_true, {_STATUS} from per",
)
def _(spark, d):
    from packetloom.operators.percentiles import LINEAR, grouped_percentiles

    scored = scored_flows(spark, d)
    wrong = F.count_if(F.col("y_true") != F.col("y_pred")) / F.count(F.lit(1))
    per = scored.groupBy("y_true").agg(
        wrong.alias("fpr"),
        F.sum("latency_ms").alias("throughput_fps"),
        (1 - wrong).alias("f1_macro"),
    )
    p95 = grouped_percentiles(scored, ["y_true"], "latency_ms", (0.95,), LINEAR)
    out = S.target_status(per.join(p95, "y_true"), p95="p95")
    return out.select(
        "y_true", "p95_latency_ok", "fpr_ok", "throughput_ok", "f1_macro_ok", "meets_targets"
    )


@query(
    "e18_metrics_long",
    f"with {REQUESTS_SQL}, {SCORED_SQL}, s as (select count(*)::double as total_requests, "
    "count(*) filter (success)::double as successful_requests, "
    "count(*) filter (not success)::double as failed_requests, "
    "count(*) filter (success)::double / count(*) as success_rate, avg(duration_ms) as avg_ms, "
    f"{_rank_sql('requests', 'duration_ms', 0.5)} as p50_ms, {_rank_sql('requests', 'duration_ms', 0.95)} as p95_ms, "
    f"{_rank_sql('requests', 'duration_ms', 0.99)} as p99_ms, ({_SPAN})::double as uptime_seconds from requests) "
    "select name, '' as label, round(value, 6) as value from (unpivot s on total_requests, successful_requests, "
    "failed_requests, success_rate, avg_ms, p50_ms, p95_ms, p99_ms, uptime_seconds into name name value value) "
    "union all select 'attacks_detected', prediction, count(*)::double from scored where prediction <> 'Normal' group by 2",
)
def _(spark, d):
    stats = S.request_stats(requests(spark, d), keep=None)
    attacks = S.attack_distribution(scored_flows(spark, d), include_normal=False)
    names = (
        "total_requests successful_requests failed_requests success_rate avg_ms p50_ms p95_ms p99_ms uptime_seconds"
    ).split()
    return rounded(S.metrics_long(stats, attacks, names))


REPORT_SQL = (
    f"with {_SCORED_CLASSES}, {_ONE_ROW} select p50, p95, p99, mean, max, samples as rows_processed, throughput_fps, "
    f"accuracy, precision_macro, recall_macro, f1_macro, fpr, peak, mean_mb, attack_distribution, {_STATUS} "
    "from lat, qual, speed, mem, dist"
)


@query("e21_evaluation_report", REPORT_SQL)
def _(spark, d):
    report = S.evaluation_report(
        scored_flows(spark, d), batch="batch", memory="memory_mb", seconds=F.sum("latency_ms") / 1000
    )
    return flat_report(report)


def flat_report(report):
    flat = report.select(
        *[F.col(f"latency_metrics.{c}_ms").alias(c) for c in ("p50", "p95", "p99", "mean", "max")],
        F.col("rows_processed").cast("bigint").alias("rows_processed"),
        "throughput_fps",
        "accuracy_metrics.accuracy",
        "accuracy_metrics.precision_macro",
        "accuracy_metrics.recall_macro",
        "accuracy_metrics.f1_macro",
        "fpr",
        F.col("memory_metrics.peak").alias("peak"),
        F.col("memory_metrics.mean").alias("mean_mb"),
        _map_text("attack_distribution").alias("attack_distribution"),
        "p95_latency_ok",
        "fpr_ok",
        "throughput_ok",
        "f1_macro_ok",
        "meets_targets",
    )
    return rounded(flat)


@query(
    "e22_summary",
    f"with {_SCORED_CLASSES}, {_ONE_ROW}, rate as (select round(count(*) / ({_SPAN}), 6) as flows_per_second, "
    f"count(*) as total_flows, round({_SPAN}, 6) as duration_seconds from scored) "
    "select p50, p95, p99, mean, std, samples, flows_per_second, total_flows, duration_seconds, accuracy, "
    "precision_macro, recall_macro, f1_macro, fpr, peak, mean_mb, mem_n, attack_distribution "
    "from lat, qual, mem, dist, rate",
)
def _(spark, d):
    out = S.summary(
        scored_flows(spark, d), "ts", "latency_ms", "memory_mb", "y_true", "y_pred"
    )
    return rounded(
        out.select(
            *[F.col(f"latency.{c}_ms").alias(c) for c in ("p50", "p95", "p99", "mean", "std")],
            "latency.samples",
            "throughput.*",
            "accuracy.*",
            "memory.peak",
            F.col("memory.mean").alias("mean_mb"),
            F.col("memory.samples").alias("mem_n"),
            _map_text("attack_distribution").alias("attack_distribution"),
        )
    )

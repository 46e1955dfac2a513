"""Queries over orders, alerts, rates, splits and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog.bindings import (
    CLEAN_FLOWS_SQL,
    REQUESTS_SQL,
    SCORED_SQL,
    raw_flows,
    requests,
    scored_flows,
    table,
)
from packetloom.catalog.registry import query, rounded
from packetloom.functions import alerts as A
from packetloom.operators import ordering as O
from packetloom.operators import rates as R
from packetloom.operators import statistics as S
from packetloom.operators.alerts import build_alerts, recent_alerts, retain_recent
from packetloom.operators.balance import (
    nearest_in_class,
    smote,
    stratified_split,
    synthetic_rows,
)
from packetloom.operators.features import engineer_features
from packetloom.operators.neighbours import nearest_by_pivots

_EVENT_ORDER = ["ts", "event_id"]

# --- windows over an order --------------------------------------------------


@query("f1_last_n", "select event_id, ts, value from events order by ts desc, event_id desc limit 1000")
def _(spark, d):
    return O.last_n(table(spark, d, "events"), _EVENT_ORDER, 1000).select("event_id", "ts", "value")


@query(
    "f1_last_n_large",
    "select event_id, ts, value from events order by ts desc, event_id desc "
    "limit (select cast(count(*) * 3 // 4 + 10001 as bigint) from events)",
)
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "value")
    return O.last_n(events, _EVENT_ORDER, events.count() * 3 // 4 + 10_001)


@query(
    "f1_last_n_text_order",
    f"with {SCORED_SQL}, a as (select timestamp, concat('alert_', cast(flow_id as string)) as id from scored "
    "where prediction <> 'Normal') select * from a order by timestamp desc, id desc "
    "limit (select cast(count(*) * 3 // 4 as bigint) from a)",
)
def _(spark, d):
    alerts = scored_flows(spark, d).filter("prediction <> 'Normal'").select(
        "timestamp", F.concat(F.lit("alert_"), F.col("flow_id").cast("string")).alias("id")
    )
    return O.last_n(alerts, ["timestamp", "id"], alerts.count() * 3 // 4)


@query(
    "f1_last_n_per_user",
    "select event_id, user_id, ts from (select *, row_number() over (partition by user_id order by ts desc, "
    "event_id desc) as rn from events) where rn <= 5",
)
def _(spark, d):
    return O.last_n(table(spark, d, "events"), _EVENT_ORDER, 5, by=["user_id"]).select(
        "event_id", "user_id", "ts"
    )


@query(
    "f2_cumulative_timeline",
    f"with {SCORED_SQL} select flow_id, cast(row_number() over w as bigint) as total, "
    "cast(sum(case when prediction <> 'Normal' then 1 else 0 end) over w as bigint) as attacks "
    "from scored window w as (order by ts, flow_id)",
)
def _(spark, d):
    flows = scored_flows(spark, d).select("flow_id", "ts", "prediction")
    return S.cumulative_timeline(flows, ["ts", "flow_id"]).select("flow_id", "total", "attacks")


@query(
    "f2_bucketed_timeline",
    f"with {SCORED_SQL}, b as (select time_bucket(interval 1 hour, ts) as bucket, count(*) as n, "
    "count(*) filter (prediction <> 'Normal') as a from scored group by 1) "
    "select bucket, cast(sum(n) over (order by bucket) as bigint) as total, "
    "cast(sum(a) over (order by bucket) as bigint) as attacks from b",
)
def _(spark, d):
    return S.bucketed_timeline(scored_flows(spark, d), "ts", "1 hour")


def _rolling_sql(by: str, size: int) -> str:
    part = f"partition by {by} " if by else ""
    return (
        f"select event_id, round(avg(sqrt(value)) over w, 6) as rolling_avg, round(min(sqrt(value)) over w, 6) as rolling_min, "
        f"round(max(sqrt(value)) over w, 6) as rolling_max from events window w as ({part}order by ts, event_id "
        f"rows between {size - 1} preceding and current row)"
    )


@query("f3_rolling_stats", _rolling_sql("", 500))
def _(spark, d):
    # roots: no average lands on a rounding tie
    events = table(spark, d, "events").select("event_id", "ts", F.sqrt("value").alias("value"))
    out = O.rolling_stats(events, "value", _EVENT_ORDER, 500, blocks=3)
    return rounded(out.drop("ts", "value"))


@query("f3_rolling_stats_per_type", _rolling_sql("event_type", 100))
def _(spark, d):
    events = table(spark, d, "events").select(
        "event_id", "ts", F.sqrt("value").alias("value"), "event_type"
    )
    out = O.rolling_stats(events, "value", _EVENT_ORDER, 100, by=["event_type"], blocks=4)
    return rounded(out.drop("ts", "value", "event_type"))


@query("f4_latest_value", "select arg_max(value, (ts, event_id)) as latest_value from events")
def _(spark, d):
    return O.latest_value(table(spark, d, "events"), "value", _EVENT_ORDER)


@query(
    "f5_every_nth",
    "select event_id, rn as row_number from (select event_id, row_number() over (order by ts, event_id) as rn "
    "from events) where rn % 100 = 0",
)
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "ts")
    return O.every_nth(events, _EVENT_ORDER, 100).select("event_id", "row_number")


@query(
    "f6_alert_id",
    f"with {SCORED_SQL} select concat('alert_', flow_id, '_', epoch_us(ts) // 1000) as id from scored "
    "where prediction <> 'Normal'",
)
def _(spark, d):
    return build_alerts(scored_flows(spark, d)).select("id")


# --- sorts and samples ------------------------------------------------------


@query(
    "g1_recent_alerts",
    f"with {SCORED_SQL} select concat('alert_', flow_id, '_', epoch_us(ts) // 1000) as id, timestamp, prediction as attack_type "
    "from scored where prediction <> 'Normal' order by timestamp desc, id desc limit 10",
)
def _(spark, d):
    alerts = build_alerts(scored_flows(spark, d))
    return recent_alerts(alerts, 10).select("id", "timestamp", "attack_type")


@query(
    "g2_top_features",
    "with o as (select vec_id, embedding as e, list_slice(list_sort(list_transform(range(0, 64), "
    "lambda i: {'a': -abs(embedding[i + 1]::double), 'i': -i})), 1, 3) as t from embeddings), "
    "x as (select vec_id, unnest(t) as t, generate_subscripts(t, 1) as place, e from o) "
    "select vec_id, cast(place as int) as place, concat('f', -t.i) as feature, round(e[-t.i + 1]::double, 6) as importance, "
    "round(-t.a, 6) as abs_importance, round(e[-t.i + 1]::double * 2, 6) as value from x",
)
def _(spark, d):
    emb = table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("e")
    )
    top = A.top_attributions(
        F.transform("e", lambda x: x * 2), F.col("e"), [f"f{i}" for i in range(64)], 3
    )
    out = emb.select("vec_id", F.posexplode(top).alias("at", "t")).select(
        "vec_id", (F.col("at") + 1).alias("place"), "t.*"
    )
    return rounded(out)


@query("g4_head", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 500")
def _(spark, d):
    return O.first_n(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 500)


@query(
    "g4_head_large",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (order by l_orderkey, l_linenumber, "
    "l_partkey, l_suppkey, l_extendedprice) as rn from lineitem) where rn <= 12345",
)
def _(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, d, "lineitem").select(*keys, "l_extendedprice")
    return O.first_n(rows, [*keys, "l_extendedprice"], 12_345).select(*keys)


@query(
    "g5_sample_exact",
    "select o_orderkey from orders order by md5(concat('42', cast(o_orderkey as string))) limit 700",
)
def _(spark, d):
    return O.sample_n(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 700)


@query(
    "g5_sample_exact_large",
    "select o_orderkey from orders order by md5(concat('7', cast(o_orderkey as string))) limit 11000",
)
def _(spark, d):
    return O.sample_n(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 11_000, seed=7)


@query(
    "g5_sample_repeated_keys",
    "select user_id, count(*) as n from (select user_id from events order by "
    "md5(concat('42', cast(user_id as string))) limit 777) group by 1",
)
def _(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id")
    return O.sample_n(events, "user_id", 777).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g5_shuffled",
    "select o_orderkey, row_number() over (order by md5(concat('42', cast(o_orderkey as string)))) as place from orders",
)
def _(spark, d):
    keys = O.shuffled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    hashed = keys.withColumn("h", O.hash_order(F.col("o_orderkey"), 42))
    return O.with_rank(hashed, ["h"], name="place").select("o_orderkey", "place")


@query(
    "h1_union_all",
    f"with {SCORED_SQL} select prediction, count(*) as n from (select * from scored union all select * from scored "
    "where prediction <> 'Normal') group by 1",
)
def _(spark, d):
    flows = scored_flows(spark, d)
    both = flows.unionByName(flows.filter(F.col("prediction") != "Normal"))
    return both.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


# --- scalar functions on their own ------------------------------------------


@query(
    "i_severity",
    f"with {SCORED_SQL} select flow_id, case when confidence > 0.8::double then 'high' else 'medium' end as severity from scored",
)
def _(spark, d):
    return scored_flows(spark, d).select("flow_id", A.severity(F.col("confidence")).alias("severity"))


@query(
    "i_argmax_class",
    "select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as int) as at, list_max(embedding)::double as p "
    "from embeddings",
)
def _(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id",
        A.argmax_index(F.col("embedding")).alias("at"),
        F.array_max("embedding").cast("double").alias("p"),
    )


@query(
    "i_alert_text",
    f"with {SCORED_SQL}, {CLEAN_FLOWS_SQL} select s.flow_id, strftime(s.ts, '%H:%M:%S') as clock, "
    "printf('%02d:%02d:%02d', floor(latency_ms * 100 / 3600)::bigint, floor((floor(latency_ms * 100)::bigint % 3600) / 60)::bigint, "
    "floor(latency_ms * 100)::bigint % 60) as uptime, "
    "concat(printf('flow_duration=%.2f (imp=%.4f)', flow_duration, 0.5::double), '; ', "
    "printf('subflow_bwd_bytes=%.2f (imp=%.4f)', subflow_bwd_bytes, 0.25::double)) as text "
    "from scored s join clean c on s.flow_id = c.flow_id",
)
def _(spark, d):
    scored = scored_flows(spark, d).select("flow_id", "timestamp", "latency_ms")
    clean = engineer_features(raw_flows(spark, d), keep=["flow_id"])

    def part(name, importance):
        return F.struct(
            F.lit(name).alias("feature"),
            F.col(name).alias("value"),
            F.lit(importance).alias("abs_importance"),
        )

    parts = F.array(part("flow_duration", 0.5), part("subflow_bwd_bytes", 0.25))
    return scored.join(clean, "flow_id").select(
        "flow_id",
        A.short_time(F.col("timestamp")).alias("clock"),
        A.uptime_text(F.col("latency_ms") * 100).alias("uptime"),
        A.feature_text(parts).alias("text"),
    )


# --- alerts and rates -------------------------------------------------------


@query(
    "j8_alerts",
    f"with {SCORED_SQL} select concat('alert_', flow_id, '_', epoch_us(ts) // 1000) as id, timestamp, src_ip, dst_ip, "
    "prediction as attack_type, confidence, case when confidence > 0.8::double then 'high' else 'medium' end as severity, "
    "concat('flow_duration=', round(confidence * 2, 6)) as features from scored where prediction <> 'Normal'",
)
def _(spark, d):
    one = F.struct(
        F.lit("flow_duration").alias("feature"),
        F.lit(0.0).alias("value"),
        (F.col("confidence") * 2).alias("importance"),
        (F.col("confidence") * 2).alias("abs_importance"),
    )
    alerts = build_alerts(scored_flows(spark, d).withColumn("top_features", F.array(one)))
    text = F.transform(
        "top_3_features",
        lambda f: F.concat_ws("=", f["feature"], F.round(f["importance"], 6).cast("string")),
    )
    return alerts.withColumn("features", F.array_join(text, ",")).drop("top_3_features")


@query(
    "k6_tumbling_rate_flags",
    f"with {REQUESTS_SQL}, w as (select client, time_bucket(interval 3600 seconds, ts) as window_start, count(*) as requests "
    "from requests group by 1, 2) select *, requests > 2 as flagged from w",
)
def _(spark, d):
    return R.tumbling_rate_flags(requests(spark, d), "client", limit=2, seconds=3600)


_ANCHOR_SECONDS = 6 * 3600


def anchored_sql(seconds: int, limit: int) -> str:
    width = seconds * 1_000_000
    return f"""with recursive {REQUESTS_SQL},
r as (select *, epoch_us(ts) as us, row_number() over (partition by client order by ts, request_id) as rn from requests),
w as (
  select client, request_id, ts, us, rn, us as open_us, cast(1 as bigint) as n from r where rn = 1
  union all
  select r.client, r.request_id, r.ts, r.us, r.rn,
    case when r.us - w.open_us >= {width} then r.us else w.open_us end,
    case when r.us - w.open_us >= {width} then 1 else w.n + 1 end
  from w join r on r.client = w.client and r.rn = w.rn + 1)
select request_id, client, make_timestamp(open_us) as window_start, n as requests, n > {limit} as flagged,
  case when n > {limit} then cast({seconds} - floor((us - open_us) / 1000000) as int) end as retry_after
from w"""


@query("k6_anchored_rate_flags", anchored_sql(_ANCHOR_SECONDS, 3))
def _(spark, d):
    flags = R.anchored_rate_flags(
        requests(spark, d), "client", ["ts", "request_id"], limit=3, seconds=_ANCHOR_SECONDS
    )
    return flags.select("request_id", "client", "window_start", "requests", "flagged", "retry_after")


@query(
    "k6_anchored_one_hot_client",
    anchored_sql(60, 1).replace("user_id as client", "0 as client"),
)
def _(spark, d):
    # all requests come from one client
    one = requests(spark, d).withColumn("client", F.lit(0))
    flags = R.anchored_rate_flags(one, "client", ["ts", "request_id"], limit=1, seconds=60)
    return flags.select("request_id", "client", "window_start", "requests", "flagged", "retry_after")


_BURST = "make_timestamp(epoch_us(ts) % 600000000)"


@query(
    "k6_anchored_burst_of_one_client",
    anchored_sql(60, 1)
    .replace("user_id as client", "0 as client")
    .replace("event_id as request_id, ts,", f"event_id as request_id, {_BURST} as ts,"),
)
def _(spark, d):
    # all requests come from one client, within ten windows
    us = F.unix_micros(F.col("ts").cast("timestamp")) % 600_000_000
    one = requests(spark, d).withColumn("client", F.lit(0)).withColumn(
        "ts", F.timestamp_micros(us).cast("timestamp_ntz")
    )
    flags = R.anchored_rate_flags(
        one, "client", ["ts", "request_id"], limit=1, seconds=60, chunk_rows=2_000
    )
    return flags.select("request_id", "client", "window_start", "requests", "flagged", "retry_after")


@query(
    "k7_windowed_metrics",
    f"with {REQUESTS_SQL}, b as (select time_bucket(interval 600 seconds, ts) as window_start, *, "
    "row_number() over (partition by time_bucket(interval 600 seconds, ts) order by duration_ms) as rn, "
    "count(*) over (partition by time_bucket(interval 600 seconds, ts)) as n from requests) "
    "select window_start, count(*) as requests, round(count(*) filter (success)::double / count(*), 6) as success_rate, "
    "round(avg(duration_ms), 6) as avg_ms, "
    "max(case when rn = least(cast(floor(n * 0.95::double) as bigint) + 1, n) then duration_ms end) as p95_ms "
    "from b group by 1",
)
def _(spark, d):
    return rounded(R.windowed_metrics(requests(spark, d), "10 minutes"))


@query(
    "k8_retention",
    "select event_id, ts from events where ts >= (select max(ts) from events) - interval 24 hours",
)
def _(spark, d):
    return retain_recent(table(spark, d, "events").select("event_id", "ts"), "ts", 24)


# --- split and balance ------------------------------------------------------


@query(
    "j1_stratified_split",
    "with c as (select label, count(*) as n from embeddings group by 1), "
    "q as (select label, n, floor(n * 0.2::double) as q, n * 0.2::double - floor(n * 0.2::double) as r from c), "
    "x as (select *, row_number() over (order by round(r, 9) desc, label) as place, "
    "(select ceil(sum(n) * 0.2::double) - sum(floor(n * 0.2::double)) from c) as missing from q), "
    "z as (select label, q + case when place <= missing then 1 else 0 end as quota from x), "
    "h as (select vec_id, label, row_number() over (partition by label order by md5(concat('42', cast(vec_id as string)))) as rn "
    "from embeddings) select vec_id, h.label, rn <= quota as is_test from h join z on h.label = z.label",
)
def _(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return stratified_split(rows, "vec_id", "label", 0.2, 42)


_NEAR_SQL = (
    "near as (select a.vec_id, a.label, b.vec_id as neighbour, "
    "list_distance(a.embedding::double[], b.embedding::double[]) as dist, row_number() over (partition by a.vec_id "
    "order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) as rank "
    "from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id)"
)


@query(
    "d2_nearest_in_class",
    f"with {_NEAR_SQL} select vec_id, label, neighbour, round(dist * dist, 6) as distance, cast(rank as int) as rank "
    "from near where rank <= 5",
)
def _(spark, d):
    near = nearest_in_class(
        table(spark, d, "embeddings"), "vec_id", "label", "embedding", 5, block_rows=40
    )
    return rounded(near)


@query(
    "d2_nearest_pruned",
    """with c as (select c_custkey, c_mktsegment, c_acctbal::double as x, c_nationkey * 100::double as y from customer),
p as (select a.c_custkey, a.c_mktsegment, b.c_custkey as neighbour, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 as distance
  from c a join c b on a.c_mktsegment = b.c_mktsegment and a.c_custkey <> b.c_custkey)
select c_custkey, c_mktsegment, neighbour, round(distance, 6) as distance,
  cast(row_number() over (partition by c_custkey order by distance, neighbour) as int) as rank
from p qualify rank <= 5""",
)
def _(spark, d):
    x = F.array(F.col("c_acctbal").cast("double"), F.col("c_nationkey") * 100.0)
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", x.alias("x"))
    return rounded(nearest_by_pivots(rows, "c_custkey", "c_mktsegment", "x", 5, cell_rows=60))


_SMOTE_SQL = f"""with {_NEAR_SQL},
c as (select label, count(*) as n from embeddings group by 1),
s as (select label, n, unnest(range(1, (select max(n) from c) - n + 1)) as slot from c),
p as (select label, slot, slot % n as at, (slot * 7919 + label * 104729) % 5 + 1 as rank,
  ((slot * 15485863 + label * 32452843) % 1000) / 1000.0::double as u from s),
b as (select *, row_number() over (partition by label order by vec_id) - 1 as at from embeddings),
n as (select p.label, p.slot, p.u, b.embedding::double[] as x, o.embedding::double[] as y
  from p join b on p.label = b.label and p.at = b.at
  join near on near.vec_id = b.vec_id and near.rank = p.rank
  join embeddings o on o.vec_id = near.neighbour)"""


@query(
    "j2_smote_new_rows",
    _SMOTE_SQL
    + " select label, slot, list_transform(range(1, 65), lambda i: round(x[i] + u * (y[i] - x[i]), 6)) as embedding from n",
)
def _(spark, d):
    from packetloom.operators.balance import known_classes, smote_plan

    rows = table(spark, d, "embeddings")
    extra, k = smote_plan(known_classes(rows, "label"))
    new = synthetic_rows(rows, "vec_id", "label", "embedding", extra, k)
    return new.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 6)))


@query(
    "j2_smote_no_class_below_target",
    "with c as (select label, count(*) as n from embeddings group by 1) "
    "select label, greatest((select max(n) from c) - n, 0) as added from c where n < (select max(n) from c)",
)
def _(spark, d):
    out = smote(table(spark, d, "embeddings"), "vec_id", "label", "embedding", target=2)
    made = out.filter("synthetic").groupBy("label")
    return made.agg(F.count(F.lit(1)).alias("added"))


@query(
    "j1_split_many_classes",
    "with c as (select o_custkey, count(*) as n from orders group by 1), "
    "q as (select o_custkey, floor(n * 0.3::double) as q, n * 0.3::double - floor(n * 0.3::double) as r from c), "
    "x as (select *, row_number() over (order by round(r, 9) desc, o_custkey) as place, "
    "(select ceil(sum(n) * 0.3::double) - sum(floor(n * 0.3::double)) from c) as missing from q) "
    "select o_custkey, cast(q + case when place <= missing then 1 else 0 end as bigint) as test_rows from x",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    split = stratified_split(rows, "o_orderkey", "o_custkey", 0.3, 42)
    return split.groupBy("o_custkey").agg(F.count_if("is_test").alias("test_rows"))


@query(
    "j2_smote_balanced",
    _SMOTE_SQL
    + ", u as (select label, false as synthetic from embeddings union all select label, true from n) "
    "select label, synthetic, count(*) as count from u group by 1, 2",
)
def _(spark, d):
    out = smote(table(spark, d, "embeddings"), "vec_id", "label", "embedding")
    return out.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("count"))



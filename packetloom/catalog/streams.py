"""Queries that run as streams, and round trips through the sources."""

from __future__ import annotations

import math
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.catalog.bindings import (
    CLEAN_FLOWS_SQL,
    MEMORY,
    PREDICTION,
    REQUESTS_SQL,
    SCORED_SQL,
    raw_flows,
    requests,
    scored_flows,
    table,
)
from packetloom.catalog.learning import VALID_SQL, flow_model
from packetloom.catalog.ordered import anchored_sql
from packetloom.catalog.registry import query, rounded
from packetloom.catalog.statistics import REPORT_SQL, flat_report
from packetloom.functions.alerts import alert_id
from packetloom.operators.explain import IMPORTANCE
from packetloom.operators.features import engineer_features, feature_map, require_columns
from packetloom.operators.statistics import evaluation_report
from packetloom.plans.detection import detect
from packetloom.schemas import FEATURES
from packetloom.session import scratch_path
from packetloom.sources.csv import (
    arrived_since,
    read_flow_stream,
    read_flows_csv,
    write_flows_csv,
)
from packetloom.sources.events import read_replay_json, write_events_json, write_replay_json
from packetloom.sources.reports import read_reports, report_path, write_report
from packetloom.streaming.rates import rate_limit_stream
from packetloom.streaming.rolling import rolling_stream
from packetloom.streaming.sinks import finish, drain, drain_totals, on_batch, replace_batch
from packetloom.streaming.statistics import (
    closing_row,
    drop_repeats,
    stream_request_metrics,
    stream_stats,
    stream_totals,
)


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table read as a stream."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def closed_event_stream(spark: SparkSession, d: str, after: str) -> DataFrame:
    """The events read as a stream, and a row behind them that closes all windows."""
    events = table(spark, d, "events")
    path = scratch_path(spark, "closing")
    closing_row(events, after).write.parquet(path)
    return event_stream(spark, d).unionByName(spark.readStream.schema(events.schema).parquet(path))


def _scored_stream(spark, d):
    return _scored(event_stream(spark, d))


def _scored(events):
    return events.selectExpr(
        "event_id as flow_id", "ts", f"{PREDICTION} as prediction", f"{MEMORY} as memory_mb"
    )


def _request_stream(spark, d, after):
    return closed_event_stream(spark, d, after).selectExpr(
        "event_id as request_id",
        "ts",
        "user_id as client",
        "value as duration_ms",
        "event_type <> 'error' as success",
    )


def _request_rows(spark, d):
    return requests(spark, d).withColumn("at", F.col("ts").cast("timestamp"))


def _ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(
    "k2_stream_stats",
    f"with {SCORED_SQL}, w as (select time_bucket(interval 1 hour, ts) as window_start, prediction as attack_type, "
    "count(*) as flows from scored group by 1, 2) select window_start, attack_type, flows, "
    "round(flows / 3600.0::double, 6) as flows_per_second, "
    "case when attack_type <> 'Normal' then flows else 0 end as alerts from w",
)
def _(spark, d):
    flows = _scored(closed_event_stream(spark, d, "70 minutes"))
    out = drain(stream_stats(flows, width="1 hour"), spark, "stats")
    return rounded(_ntz(out, "window_start"))


@query(
    "k2_stream_totals",
    f"with {SCORED_SQL} select prediction as attack_type, count(*) as flows from scored group by 1",
)
def _(spark, d):
    return drain_totals(stream_totals(_scored_stream(spark, d)), spark, "totals")


@query(
    "k3_foreach_batch",
    f"with {SCORED_SQL} select flow_id, prediction from scored where prediction <> 'Normal'",
)
def _(spark, d):
    path = scratch_path(spark, "foreach")
    alerts = _scored_stream(spark, d).filter("prediction <> 'Normal'").select("flow_id", "prediction")
    writer = on_batch(alerts, replace_batch(f"{path}/rows"), f"{path}/checkpoint")
    finish(writer.trigger(availableNow=True).start())
    return spark.read.schema(alerts.schema).parquet(f"{path}/rows").drop("batch_id")


_LAST = "over (partition by client order by ts, request_id rows between 99 preceding and current row)"


@query(
    "k2_stream_rolling_latency",
    f"with {REQUESTS_SQL}, r as (select *, case when isfinite(duration_ms) then duration_ms else 0 end as v "
    f"from requests) select request_id, client, round(avg(v) {_LAST}, 9) as rolling_avg, "
    f"round(min(v) {_LAST}, 9) as rolling_min, round(max(v) {_LAST}, 9) as rolling_max, "
    f"round(quantile_cont(v, 0.95) {_LAST}, 9) as rolling_p from r",
)
def _(spark, d):
    rows = _request_stream(spark, d, "2 minutes")
    out = rolling_stream(rows, "client", "request_id", "duration_ms", size=100, delay="1 minute")
    # hundredths over at most 100 rows are never half of the ninth digit
    return rounded(drain(out, spark, "rolling"), 9)


_LATE = "11 days"
#: turns in which the requests arrive, and rows of a file
_TURNS, _FILE_ROWS = 12, 500_000


@query(
    "k6_stream_rate_limit",
    anchored_sql(6 * 3600, 3).replace(
        "make_timestamp(open_us) as window_start", "open_us as window_us"
    ),
)
def _(spark, d):
    # stretches of five days, each pair of them in the wrong order, a turn a trigger;
    # the last file is a row behind the watermark of all requests
    path = scratch_path(spark, "requests")
    rows = requests(spark, d).select("request_id", "client", F.col("ts").cast("timestamp").alias("at"))
    stretch = F.floor(F.unix_seconds("at") / (5 * 86_400))
    first, last = rows.agg(F.min(stretch), F.max(stretch)).first()
    # of a long time several stretches a turn, an odd number: turns end within pairs
    length = math.ceil(((last or 0) - (first or 0) + 1) / _TURNS) // 2 * 2 + 1
    turn = F.floor((stretch - F.lit(first)).bitwiseXOR(F.lit(1)) / length).alias("turn")
    sizes = rows.filter("at is not null").groupBy(turn).count().sort("turn").collect()
    files = max([1, *(math.ceil(r["count"] / _FILE_ROWS) for r in sizes)])
    for r in sizes:
        part = rows.filter(turn == r["turn"])
        part = part.coalesce(1) if files == 1 else part.repartition(files, "request_id")
        part.write.option("compression", "zstd").mode("append").parquet(path)
    closing = closing_row(rows, _LATE, "at").withColumn("request_id", F.lit(-1).cast("long"))
    closing.to(rows.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    flags = rate_limit_stream(
        stream, "client", "request_id", ts="at", limit=3, seconds=6 * 3600, delay=_LATE
    )
    return drain(flags, spark, "rates")


@query(
    "k7_stream_request_metrics",
    f"with {REQUESTS_SQL} select time_bucket(interval 1 hour, ts) as window_start, count(*) as requests, "
    "round(count(*) filter (success)::double / count(*), 6) as success_rate, round(avg(duration_ms), 6) as avg_ms, "
    "true as p95_is_near from requests group by 1",
)
def _(spark, d):
    out = drain(stream_request_metrics(_request_stream(spark, d, "61 minutes"), "1 hour"), spark, "metrics")
    # the sketch is within a tenth of a percent of ranks of the exact value
    rows = _request_rows(spark, d).groupBy(F.window("at", "1 hour")["start"].alias("window_start"))
    exact = rows.agg(
        F.expr("percentile_disc(0.94) within group (order by duration_ms)").alias("low"),
        F.expr("percentile_disc(0.96) within group (order by duration_ms)").alias("high"),
    )
    near = F.col("p95_ms").between(F.col("low"), F.col("high")).alias("p95_is_near")
    both = out.join(exact, "window_start")
    return rounded(_ntz(both, "window_start").select("window_start", "requests", "success_rate", "avg_ms", near))


@query("k9_stream_without_repeats", "select event_id, ts from events")
def _(spark, d):
    events = event_stream(spark, d).select("event_id", "ts")
    twice = events.unionByName(events)
    return _ntz(drain(drop_repeats(twice, ["event_id"], delay="60 days"), spark, "repeats"), "ts")


@query("k1_detect_stream", f"{VALID_SQL} select flow_id, true as alert_is_attack from valid")
def _(spark, d):
    # the flows lie as CSV files in a folder that the stream watches
    path = scratch_path(spark, "incoming")
    _flow_files(spark, d, path)
    rows = read_flow_stream(spark, path, max_files=4)
    model = flow_model(spark, d)
    alerts = drain(detect(rows, model, method=IMPORTANCE).alerts(), spark, "alerts")
    # the batch run over the same files says which flows must have an alert
    scored = detect(read_flows_csv(spark, path), model, method=IMPORTANCE).scored
    flows = scored.select(
        F.col("flow_id").cast("bigint").alias("flow_id"),
        "prediction",
        alert_id(F.col("flow_id"), F.col("ts")).alias("id"),
    )
    beside = flows.join(alerts.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left")
    attack = (F.col("prediction") != "Normal").cast("int")
    return beside.select("flow_id", (F.coalesce("n", F.lit(0)) == attack).alias("alert_is_attack"))


def _flow_files(spark, d, path):
    names = scored_flows(spark, d).select("flow_id", "timestamp", "src_ip", "dst_ip")
    raw = raw_flows(spark, d).drop("ts", "flow_duration", "Label")
    write_flows_csv(names.join(raw, "flow_id"), path)


@query(
    "a1_csv_round_trip",
    f"with {CLEAN_FLOWS_SQL} select cast(flow_id as string) as flow_id, "
    + ", ".join(f"round({f}, 6) as {f}" for f in FEATURES)
    + " from clean",
)
def _(spark, d):
    path = scratch_path(spark, "flows-csv")
    write_flows_csv(raw_flows(spark, d).drop("ts", "flow_duration"), path)
    return rounded(engineer_features(read_flows_csv(spark, path), keep=["flow_id"]))


@query(
    "a5_files_since_start",
    "select cast(event_id as string) as event_id from events where event_id % 2 = 1",
)
def _(spark, d):
    path = scratch_path(spark, "tail")
    rows = table(spark, d, "events").select("event_id", "event_type")
    write_flows_csv(rows.filter("event_id % 2 = 0").coalesce(1), path)
    time.sleep(2)  # file times may be whole seconds
    start = datetime.now(UTC)
    write_flows_csv(rows.filter("event_id % 2 = 1"), path, mode="append")
    return drain(arrived_since(read_flow_stream(spark, path), start).select("event_id"), spark, "since")


@query(
    "a2_missing_and_empty_files",
    "select * from (values ('empty', 'ValueError'), ('missing', 'FileNotFoundError'), "
    "('rows', (select cast(count(*) as string) from events))) t(case_name, outcome)",
)
def _(spark, d):
    path = scratch_path(spark, "csv")
    write_flows_csv(table(spark, d, "events").select("event_id", "event_type"), f"{path}/rows")
    spark.createDataFrame([], "x string").coalesce(1).write.text(f"{path}/empty")
    found = []
    for name in ("empty", "missing"):
        try:
            read_flows_csv(spark, f"{path}/{name}")
            found.append((name, "read"))
        except (ValueError, FileNotFoundError) as error:
            found.append((name, type(error).__name__))
    counted = read_flows_csv(spark, f"{path}/rows").agg(
        F.lit("rows").alias("case_name"), F.count(F.lit(1)).cast("string").alias("outcome")
    )
    return spark.createDataFrame(found, "case_name string, outcome string").unionByName(counted)


@query(
    "b19_column_contract",
    "select * from (values ('with label', 'accepted'), ('without label', 'ValueError')) t(case_name, outcome) "
    "where exists (select * from events)",
)
def _(spark, d):
    flows = raw_flows(spark, d)
    out = []
    for name, frame in (("with label", flows), ("without label", flows.drop("Label"))):
        try:
            require_columns(frame, "Label")
            out.append((name, "accepted"))
        except ValueError:
            out.append((name, "ValueError"))
    return spark.createDataFrame(out, "case_name string, outcome string")


def _events(spark, d):
    clean = engineer_features(raw_flows(spark, d), keep=["flow_id"])
    flows = scored_flows(spark, d).select(
        "flow_id", "timestamp", "src_ip", "dst_ip", "prediction", "latency_ms", "confidence"
    )
    alert = F.when(
        F.col("prediction") != "Normal",
        F.struct(
            F.col("flow_id").cast("string").alias("id"),
            "timestamp",
            "src_ip",
            "dst_ip",
            F.col("prediction").alias("attack_type"),
            "confidence",
        ),
    )
    return flows.join(clean, "flow_id").select(
        "timestamp",
        "latency_ms",
        feature_map().alias("flow_features"),
        "src_ip",
        "dst_ip",
        alert.alias("alert"),
    )


_REPLAY_FIELDS = ("flow_duration", "flow_iat_max", "down_up_ratio", "subflow_bwd_bytes")
_REPLAY_SQL = (
    f"with {SCORED_SQL}, {CLEAN_FLOWS_SQL} select s.src_ip, s.dst_ip, cast(trunc(c.total_fwd_packets) as bigint) "
    "as total_fwd_packets, "
    + ", ".join(f"round(c.{f}, 6) as {f}" for f in _REPLAY_FIELDS)
    + " from scored s join clean c on s.flow_id = c.flow_id"
)


@query("a6_event_log", _REPLAY_SQL)
def _(spark, d):
    path = scratch_path(spark, "events")
    write_events_json(_events(spark, d), path)
    flows = read_replay_json(spark, path)
    return rounded(flows.select("src_ip", "dst_ip", "total_fwd_packets", *_REPLAY_FIELDS))


@query("a1_csv_sample", "select least(count(*), 321) as rows, least(count(*), 321) as ids from events")
def _(spark, d):
    path = scratch_path(spark, "csv")
    write_flows_csv(table(spark, d, "events").select("event_id", "event_type"), path)
    rows = read_flows_csv(spark, path, sample_size=321)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("ids"))


@query(
    "a7_replay_oldest",
    f"with {SCORED_SQL} select src_ip, dst_ip from scored order by timestamp limit 555",
)
def _(spark, d):
    path = scratch_path(spark, "replay")
    write_events_json(_events(spark, d), path)
    return read_replay_json(spark, path, max_flows=555).select("src_ip", "dst_ip")


@query("a7_replay_of_alerts", _REPLAY_SQL + " where s.prediction <> 'Normal'")
def _(spark, d):
    path = scratch_path(spark, "replay")
    write_replay_json(_events(spark, d), path)
    flows = read_replay_json(spark, path)
    return rounded(flows.select("src_ip", "dst_ip", "total_fwd_packets", *_REPLAY_FIELDS))


@query("a9_saved_report", REPORT_SQL)
def _(spark, d):
    folder = scratch_path(spark, "reports")
    report = evaluation_report(scored_flows(spark, d), memory="memory_mb")
    write_report(report, report_path(folder))
    saved = read_reports(spark, folder)
    # JSON keeps the map of counts as a struct of its keys
    kind = saved.schema["attack_distribution"].dataType
    if not isinstance(kind, T.MapType):
        names = kind.fieldNames()
        entries = [x for n in names for x in (F.lit(n), F.col(f"attack_distribution.`{n}`"))]
        saved = saved.withColumn("attack_distribution", F.create_map(*entries))
    return flat_report(saved)


@query(
    "k5_recent_from_alert_table",
    f"with {SCORED_SQL} select flow_id, prediction from scored where prediction <> 'Normal' "
    "order by ts desc, flow_id desc limit 1000",
)
def _(spark, d):
    from packetloom.operators.ordering import last_n

    rows = _scored_stream(spark, d).filter("prediction <> 'Normal'").select("flow_id", "ts", "prediction")
    saved = drain(rows, spark, "alert-table")
    return last_n(saved, ["ts", "flow_id"], 1000).select("flow_id", "prediction")

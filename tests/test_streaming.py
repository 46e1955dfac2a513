import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators.explain import IMPORTANCE
from packetloom.operators.model import FOREST, FlowModel, fit_classifier
from packetloom.plans.detection import detect
from packetloom.schemas import FEATURE_HEADERS, FEATURES
from packetloom.sources.csv import (
    arrived_since,
    read_flow_stream,
    read_flows_csv,
    write_flows_csv,
)
from packetloom.sources.events import (
    read_events_json,
    read_replay_json,
    stream_events_json,
    write_events_json,
    write_replay_json,
)
from packetloom.sources.reports import report_path, write_report
from packetloom.streaming.rates import rate_limit_stream
from packetloom.streaming.sinks import alert_table, drain, finish
from packetloom.streaming.statistics import drop_repeats, stream_stats


def _csv(spark, path, first, n):
    columns = [
        (F.rand(first) * 100).cast("string").alias(h) for h in FEATURE_HEADERS.values()
    ]
    frame = spark.range(first, first + n, numPartitions=1).select(
        F.col("id").cast("string").alias("flow_id"),
        F.format_string("2024-01-01T00:%02d:00", F.col("id") % 60).alias("Timestamp"),
        F.lit("10.0.0.1").alias("Source IP"),
        *columns,
    )
    write_flows_csv(frame, path, mode="append")


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.range(400).select(
        (F.col("id") % 3).cast("int").alias("y"),
        *[(F.rand(i) * 100 + (F.col("id") % 3) * 5).alias(f) for i, f in enumerate(FEATURES)],
    )
    return FlowModel(fit_classifier(rows, "y", algorithm=FOREST, rounds=4, depth=3), FOREST)


def _plain(df):
    return sorted(map(str, df.collect()))


def test_stream_equals_batch_and_restart_adds_no_rows(spark, model, tmp_path):
    source = str(tmp_path / "in")
    _csv(spark, source, 0, 80)
    stream = read_flow_stream(spark, source, max_files=1)

    def run():
        alerts = detect(stream, model).alerts()
        writer = alert_table(alerts, str(tmp_path / "out"), str(tmp_path / "check"))
        finish(writer.trigger(availableNow=True).start())
        return spark.read.parquet(str(tmp_path / "out"))

    assert _plain(run()) == _plain(detect(read_flows_csv(spark, source), model).alerts())
    _csv(spark, source, 500, 40)
    assert _plain(run()) == _plain(detect(read_flows_csv(spark, source), model).alerts())
    assert run().select("id").distinct().count() == run().count()


def test_event_log_and_replay(spark, model, tmp_path):
    source = str(tmp_path / "in")
    _csv(spark, source, 0, 50)
    found = detect(read_flows_csv(spark, source), model, method=IMPORTANCE)
    log, replay = str(tmp_path / "log"), str(tmp_path / "replay")
    write_events_json(found.events(), log)
    write_replay_json(found.events(), replay)
    attacks = found.alerts().count()
    assert 0 < attacks < 50
    assert read_events_json(spark, log).count() == 50
    again = read_replay_json(spark, replay)
    assert again.count() == attacks
    assert detect(again, model, method=IMPORTANCE).alerts().count() == attacks
    assert read_replay_json(spark, replay, max_flows=3).count() == 3
    events = detect(read_flow_stream(spark, source), model, method=IMPORTANCE).events()
    out = str(tmp_path / "streamed")
    finish(
        stream_events_json(events, out, str(tmp_path / "c"), alerts_only=True)
        .trigger(availableNow=True)
        .start()
    )
    assert read_events_json(spark, out).count() == attacks
    with pytest.raises(FileNotFoundError):
        read_replay_json(spark, str(tmp_path / "none"))


def test_sources_reject_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_flows_csv(spark, str(tmp_path / "none.csv"))
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(ValueError, match="empty"):
        read_flows_csv(spark, str(empty))
    with pytest.raises(ValueError, match="format"):
        write_report(spark.range(1), report_path(str(tmp_path)), "html")
    padded = tmp_path / "padded.csv"
    padded.write_text(" Flow Duration, Label\n1,BENIGN\n")
    assert read_flows_csv(spark, str(padded)).columns == ["Flow Duration", "Label"]


def test_only_new_files(spark, tmp_path):
    source = str(tmp_path / "in")
    _csv(spark, source, 0, 10)
    for start, want in ((datetime(2020, 1, 1), 10), (datetime(2100, 1, 1), 0)):
        rows = arrived_since(read_flow_stream(spark, source), start).select("flow_id")
        assert drain(rows, spark, "since").count() == want


def _parts(spark, path, batches, schema):
    """One Parquet file per micro-batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/p={i}")
    kinds = spark.read.parquet(path).drop("p").schema
    return (
        spark.readStream.schema(kinds)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(path)
    )


def test_late_rows_are_dropped(spark, tmp_path):
    def at(minute, second=0):
        return datetime(2024, 1, 1, 0, minute, second)

    batches = [
        [(at(0, 5), "DoS"), (at(0, 50), "Normal")],
        [(at(30), "DoS")],
        [(at(31), "DoS")],
        [(at(0, 20), "DoS"), (at(32), "DoS")],
        [(at(59), "Normal")],
    ]
    stream = _parts(spark, str(tmp_path / "in"), batches, "ts timestamp, prediction string")
    out = drain(stream_stats(stream, width="1 minute", delay="5 minutes"), spark, "late")
    first = {r["attack_type"]: r["flows"] for r in out.filter("window_start < '2024-01-01 00:01:00'").collect()}
    assert first == {"DoS": 1, "Normal": 1}


def test_repeats_pass_once(spark, tmp_path):
    row = (1, datetime(2024, 1, 1))
    stream = _parts(spark, str(tmp_path / "in"), [[row, row], [row], [(2, datetime(2024, 1, 1))]], "id long, ts timestamp")
    assert drain(drop_repeats(stream, ["id"]), spark, "repeats").count() == 2


def test_rate_windows_across_micro_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted(
        (rng.randrange(400_000_000), rng.choice("aab"), i) for i in range(300)
    )
    shuffled = rows[:]
    for k in range(0, 300, 60):  # out of order, and across files
        part = shuffled[k : k + 60]
        rng.shuffle(part)
        shuffled[k : k + 60] = part
    batches = [
        [(i, c, datetime.fromtimestamp(us / 1e6 + 1_704_067_200)) for us, c, i in shuffled[k : k + 25]]
        for k in range(0, 300, 25)
    ]
    stream = _parts(spark, str(tmp_path / "in"), batches, "id long, client string, ts timestamp")
    out = drain(rate_limit_stream(stream, "client", "id", limit=10, delay="3 minutes"), spark, "rates")
    closed = rows[-1][0] - 180_000_000
    got = {r["id"]: (r["requests"], r["flagged"], r["retry_after"]) for r in out.collect()}
    state = {}
    for us, client, i in rows:
        opened, count = state.get(client, (None, 0))
        if opened is None or us - opened >= 60_000_000:
            opened, count = us, 0
        state[client] = (opened, count + 1)
        wait = 60 - (us - opened) // 1_000_000 if count + 1 > 10 else None
        if us >= closed:  # the watermark has not passed it yet
            continue
        assert got[i][:2] == (count + 1, count + 1 > 10)
        assert got[i][2] is wait or abs(got[i][2] - wait) <= 1


def test_csv_stream_with_other_column_order_fails(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("1", "a")], "flow_id string, x string").coalesce(1).write.csv(source, header=True)
    stream = read_flow_stream(spark, source, max_files=1)
    spark.createDataFrame([("b", "2")], "x string, flow_id string").coalesce(1).write.mode("append").csv(
        source, header=True
    )
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        drain(stream, spark, "columns")


def test_cluster_needs_a_shared_folder(spark):
    from packetloom.session import scratch_path

    class Conf:
        def get(self, *_):
            return None

    class Elsewhere:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Elsewhere(), "x")


def test_every_row_of_the_closed_queries_comes_out(spark, sf_dir):
    from packetloom.catalog import QUERIES

    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert QUERIES["k6_stream_rate_limit"](spark, sf_dir).select("request_id").distinct().count() == events
    for name, column in (("k2_stream_stats", "flows"), ("k7_stream_request_metrics", "requests")):
        assert QUERIES[name](spark, sf_dir).agg(F.sum(column)).first()[0] == events


@pytest.mark.parametrize("width", [1, 40, 10**6])
def test_numbers_of_many_clients_at_once(width):
    from packetloom.streaming.rates import _number

    rng = np.random.default_rng(width)
    client = np.sort(np.append(rng.integers(0, 50, 3000), np.arange(50)))
    us = rng.integers(0, 3000, len(client))
    us[client == 7] += 2**62 // 3 if width > 1 else 0  # times too far apart to lie beside each other
    order = np.lexsort((us, client))
    us = us[order]
    opened, count = np.full(50, -20), rng.integers(0, 3, 50)
    window, number = _number(client, us, opened, count, width)
    state = {c: (opened[c], count[c]) for c in range(50)}
    for i, (c, at) in enumerate(zip(client, us)):
        begin, n = state[c]
        if not n or at - begin >= width:
            begin, n = at, 0
        state[c] = (begin, n + 1)
        assert (window[i], number[i]) == state[c]


def test_clients_share_states(spark, tmp_path):
    rows = [(i, None if i % 400 == 9 else i % 400, datetime(2024, 1, 1, 0, i % 7, i % 60)) for i in range(2000)]
    rows.append((2000, 1, datetime(2024, 1, 1, 1)))
    stream = _parts(spark, str(tmp_path / "in"), [rows[:900], rows[900:]], "id long, client long, ts timestamp")
    flags = rate_limit_stream(stream, "client", "id", limit=1, delay="30 minutes", buckets=16)
    seen = []
    query = (
        flags.writeStream.foreachBatch(lambda batch, _: seen.extend(batch.collect()))
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 17
    state, want = {}, {}
    for i, client, at in sorted(rows[:-1], key=lambda r: (r[2], r[0])):
        opened, n = state.get(client, (None, 0))
        if opened is None or (at - opened).total_seconds() >= 60:
            opened, n = at, 0
        state[client] = (opened, n + 1)
        want[i] = (client, n + 1)
    assert {r["id"]: (r["client"], r["requests"]) for r in seen} == want


@pytest.mark.parametrize("days", [[0, 1, 500, 504, 507], [3 * i for i in range(60)]])
def test_requests_with_gaps_and_of_a_long_time_come_out(spark, tmp_path, days):
    from packetloom.catalog import QUERIES

    begin = datetime(2024, 1, 1)
    rows = [(10 * d + i, begin + timedelta(days=d, hours=i), i % 4, "view", 1.0, "") for d in days for i in range(8)]
    kind = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["k6_stream_rate_limit"](spark, str(tmp_path))
    assert {r[0] for r in found.select("request_id").collect()} == {r[0] for r in rows}
    assert found.count() == len(rows)

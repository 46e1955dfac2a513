import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from packetloom.operators.epochs import epoch_stats, with_epoch
from packetloom.operators.sketches import RANK_ERROR, read_sketches, rolled_up, sketch_percentile, sketched, write_sketches
from packetloom.streaming.sinks import drop_days, read_days, write_by_day

T0 = datetime(2024, 3, 1)


def _rank_is_near(values, p, got):
    values = sorted(values)
    below = sum(v < got for v in values) / len(values)
    upto = sum(v <= got for v in values) / len(values)
    return below <= p + RANK_ERROR and upto >= p - RANK_ERROR


def test_sketches_merge_to_any_span(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(T0 + timedelta(minutes=rnd.randrange(6000)), rnd.choice("ab"), rnd.lognormvariate(1, 2)) for _ in range(20_000)]
    rows += [(T0, "a", 5.0)] * 3000 + [(T0, "a", None), (T0, "a", float("nan")), (None, "b", 7.0)]
    df = spark.createDataFrame(rows, "ts timestamp, c string, v double")
    path = str(tmp_path / "hours")
    table = sketched(df, "v", "ts", ["c"])
    write_sketches(table, path)
    write_sketches(table, path)  # a repeated run replaces its days
    stored = read_sketches(spark, path)
    assert stored.count() == table.count()
    for by in ([], ["c"], ["c", F.to_date("start").alias("day")]):
        out = rolled_up(stored, by).withColumns({f"p{i}": sketch_percentile(p) for i, p in enumerate((0.5, 0.95))})
        for r in out.collect():
            d = r.asDict()
            own = [
                v for t, c, v in rows
                if v is not None and v == v and d.get("c", c) == c and ("day" not in d or d["day"] == (t and t.date()))
            ]
            assert (d["n"], d["least"], d["most"]) == (len(own), min(own), max(own))
            assert d["total"] == pytest.approx(sum(own))
            assert _rank_is_near(own, 0.5, d["p0"]) and _rank_is_near(own, 0.95, d["p1"])
    assert sketched(df.limit(0), "v", "ts").count() == 0


def test_only_the_asked_days_of_sketches_are_read(spark, tmp_path):
    df = spark.range(2000).select(F.lit(T0).alias("t0"), (F.col("id") * 1.0).alias("v"), "id")
    df = df.select(F.timestamp_add("hour", F.col("id").cast("int") % 200, "t0").alias("ts"), "v")
    path = str(tmp_path / "hours")
    write_sketches(sketched(df, "v", "ts"), path)
    part = read_sketches(spark, path, date(2024, 3, 2), date(2024, 3, 3))
    assert part.count() == 48
    assert "PartitionFilters: [isnotnull(day" in part._jdf.queryExecution().toString()


def test_days_are_dropped_whole(spark, tmp_path):
    path = str(tmp_path / "alerts")
    rows = [(i, T0 + timedelta(hours=5 * i)) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, ts timestamp")
    write_by_day(df, path)
    write_by_day(df, path)
    assert read_days(spark, path).count() == 41
    assert drop_days(spark, path, date(2024, 3, 4)) == ["2024-03-01", "2024-03-02", "2024-03-03"]
    assert drop_days(spark, path, date(2024, 3, 4)) == []
    left = {r.id for r in read_days(spark, path).collect()}
    assert left == {i for i, t in rows if t is None or t >= datetime(2024, 3, 4)}
    late = read_days(spark, path, date(2024, 3, 8))
    assert {r.id for r in late.collect()} == {i for i, t in rows if t and t >= datetime(2024, 3, 8)}
    assert "PartitionFilters: [isnotnull(day" in late._jdf.queryExecution().toString()


def test_rows_belong_to_the_last_reset(spark):
    rnd = random.Random(5)
    # a third of the rows share one moment, which is a reset too
    rows = [(i, T0 + timedelta(seconds=rnd.randrange(900)), "DoS" if i % 3 else "Normal", i * 1.0) for i in range(600)]
    rows += [(1000 + i, T0 + timedelta(seconds=300), "Normal", 2.0) for i in range(300)] + [(5000, None, "DoS", 1.0)]
    resets = [T0 + timedelta(seconds=s) for s in (100, 300, 300, 300, 450, 5000)] + [None]
    df = spark.createDataFrame(rows, "id long, ts timestamp, prediction string, latency_ms double")
    marks = spark.createDataFrame([(r,) for r in resets], "at timestamp")
    moments = sorted({r for r in resets if r})
    expected = {i: None if t is None else sum(m <= t for m in moments) for i, t, *_ in rows}
    assert {r.id: r.epoch for r in with_epoch(df, "ts", marks, "at").collect()} == expected
    got = {r.epoch: r for r in epoch_stats(df, "ts", marks, "at").collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    for e, r in got.items():
        own = [x for x in rows if expected[x[0]] == e]
        assert (r.total_flows, r.attack_flows) == (len(own), sum(x[2] != "Normal" for x in own))
        assert r.epoch_start == (moments[e - 1] if e else None)
        assert r.avg_latency_ms == pytest.approx(sum(x[3] for x in own) / len(own) if own else 0)
    assert got[4].flows_per_second == 0  # a reset that nothing followed
    none = with_epoch(df, "ts", marks.limit(0), "at")
    assert {r.epoch for r in none.filter("ts is not null").collect()} == {0}
    assert with_epoch(df.limit(0), "ts", marks, "at").count() == 0

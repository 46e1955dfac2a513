import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import ordering as O
from packetloom.operators.rates import anchored_rate_flags


def _skewed(spark, n=4000, seed=3):
    """One client and one time hold a third of the rows each."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        client = 0 if i % 3 == 0 else rng.randrange(1, 40)
        at = 500_000 if rng.random() < 0.33 else rng.randrange(0, 3_000_000)
        rows.append((i, client, at, rng.randrange(10)))
    return rows, spark.createDataFrame(rows, "id long, client long, at long, v int").repartition(4)


def test_running_totals_with_ties(spark):
    rows, frame = _skewed(spark)
    got = {r["id"]: (r["rank"], r["s"]) for r in O.running_totals(
        frame, {"rank": F.lit(1).cast("long"), "s": F.col("v").cast("long")}, ["at", "id"], buckets=16
    ).collect()}
    total = 0
    for place, row in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1):
        total += row[3]
        assert got[row[0]] == (place, total)


def test_hot_value_is_cut(spark):
    _, frame = _skewed(spark)
    sizes = [r["count"] for r in O.with_order_bucket(frame, ["at", "id"], 16).groupBy("_order_bucket").count().collect()]
    assert sum(sizes) == 4000
    assert max(sizes) < 4000 / 16 * 3


def test_rank_within_hot_client(spark):
    rows, frame = _skewed(spark)
    got = {r["id"]: r["rank"] for r in O.with_rank(frame, ["at", "id"], ["client"]).collect()}
    seen = {}
    for row in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[row[1]] = seen.get(row[1], 0) + 1
        assert got[row[0]] == seen[row[1]]


def test_null_and_nan_order(spark):
    frame = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0), (4, -1.0)], "id long, x double")
    got = [r["id"] for r in O.with_rank(frame, ["x", "id"]).orderBy("rank").collect()]
    assert got == [1, 4, 3, 2]


def test_text_order(spark):
    names = ["", "b", "a", "user_2", "user_10", "é", "zzzzzzzz", "zzzzzzza", None]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r["name"] for r in O.with_rank(frame, ["name"], buckets=8).orderBy("rank").collect()]
    assert got == [r["name"] for r in frame.orderBy("name").collect()]


def test_last_n_per_group_and_overall(spark):
    rows, frame = _skewed(spark)
    got = {r["id"] for r in O.last_n(frame, ["at", "id"], 7, by=["client"]).collect()}
    want = set()
    for c in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0]))
        want |= {r[0] for r in mine[-7:]}
    assert got == want
    with pytest.raises(ValueError):
        O.last_n(frame, ["at"], -1)
    assert O.last_n(frame, ["at", "id"], 0).count() == 0


def test_samples_are_exact_and_repeatable(spark, monkeypatch):
    _, frame = _skewed(spark)
    one = {r["id"] for r in O.sample_n(frame, "id", 1234).collect()}
    monkeypatch.setattr(O, "_SLICE_ROWS", 2)  # further digits
    again = {r["id"] for r in O.sample_n(frame.repartition(7), "id", 1234).collect()}
    assert one == again and len(one) == 1234
    assert O.sample_n(frame, "id", 99_999).count() == 4000
    assert O.first_n(frame, ["at", "id"], 50).count() == 50
    assert [r["id"] for r in O.shuffled(frame, "id").limit(3).collect()] != [0, 1, 2]


def test_sample_of_repeated_keys_is_exact(spark):
    _, frame = _skewed(spark)
    for n in (0, 1, 100, 1500, 3999):
        assert O.sample_n(frame, "client", n).count() == n
    one = spark.createDataFrame([(1, "x")] * 50, "id long, t string")
    assert O.sample_n(one, "id", 7).count() == 7


def test_first_rows_with_ties_and_nulls(spark):
    frame = spark.createDataFrame([(None,)] * 5 + [(1,)] * 40 + [(2,)] * 5, "x int").repartition(3)
    assert [r["x"] for r in O.first_n(frame, ["x"], 30).orderBy("x").collect()] == [None] * 5 + [1] * 25
    assert [r["x"] for r in O.last_n(frame, ["x"], 7).orderBy("x").collect()] == [1, 1] + [2] * 5


@pytest.mark.parametrize("kind", ["time", "alert"])
def test_long_common_beginnings_are_spread(spark, kind):
    text = F.concat(F.lit("2024-01-01T00:00:00."), F.lpad("id", 6, "0"))
    if kind == "alert":
        text = F.concat(F.lit("alert_"), F.md5(F.col("id").cast("string")))
    frame = spark.range(8000).select(text.alias("t"), F.lit(1).alias("same"), "id")
    for order in (["t"], ["same", "t"]):
        sizes = O.with_order_bucket(frame, order, 64).groupBy("_order_bucket").count().collect()
        assert max(r["count"] for r in sizes) <= 2 * 8000 / 64


def test_rolling_stats_across_chunks(spark):
    rows, frame = _skewed(spark, 900)
    got = {r["id"]: (r["rolling_min"], r["rolling_max"], r["rolling_avg"]) for r in O.rolling_stats(
        frame, "v", ["at", "id"], size=20, by=["client"], blocks=3
    ).collect()}
    assert len(got) == 900
    for c in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0]))
        for i, row in enumerate(mine):
            last = [r[3] for r in mine[max(0, i - 19) : i + 1]]
            low, high, mean = got[row[0]]
            assert (low, high) == (min(last), max(last))
            assert mean == pytest.approx(sum(last) / len(last))


@pytest.mark.parametrize("span", [400_000_000, 20_000_000_000])
def test_anchored_windows_against_replay(spark, span):
    rng = random.Random(span)
    rows = []
    for i in range(2500):
        client = "busy" if i % 3 else f"c{rng.randrange(30)}"
        at = 7_000_000 if rng.random() < 0.1 else rng.randrange(span)
        rows.append((i, client, at))
    frame = spark.createDataFrame(rows, "id long, client string, us long").select(
        "id", "client", F.timestamp_micros("us").alias("ts")
    )
    got = {
        r["id"]: (r["at"], r["requests"], r["flagged"], r["retry_after"])
        for r in anchored_rate_flags(frame, "client", ["ts", "id"], limit=5, buckets=12, chunk_rows=150)
        .withColumn("at", F.unix_micros("window_start"))
        .collect()
    }
    assert len(got) == len(rows)
    state = {}
    for i, client, us in sorted(rows, key=lambda r: (r[2], r[0])):
        opened, count = state.get(client, (None, 0))
        if opened is None or us - opened >= 60_000_000:
            opened, count = us, 0
        count += 1
        state[client] = (opened, count)
        wait = 60 - (us - opened) // 1_000_000 if count > 5 else None
        assert got[i] == (opened, count, count > 5, wait)

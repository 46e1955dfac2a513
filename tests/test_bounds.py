"""Bounds of the first rows: right for every type, and narrow."""

import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import bounds
from packetloom.operators.ordering import first_n, last_n

KINDS = {
    "long": lambda r: r.choice([r.randrange(10**6), 2**62, -(2**62)]),
    "double": lambda r: r.choice([r.random(), r.gauss(0, 1e300), float("inf"), float("-inf"), float("nan")]),
    "string": lambda r: "2024-01-" + r.choice(["", "x", "é", "日本", str(r.randrange(10**9))]),
    "timestamp": lambda r: dt.datetime(2024, 3, 31) + dt.timedelta(microseconds=r.randrange(10**11)),
    "timestamp_ntz": lambda r: dt.datetime(1912, 3, 31) + dt.timedelta(microseconds=r.randrange(10**17)),
    "date": lambda r: dt.date(2020, 1, 1) + dt.timedelta(days=r.randrange(900)),
    "decimal(20,4)": lambda r: decimal.Decimal(r.randrange(10**9)) / 10_000,
    "boolean": lambda r: r.random() < 0.5,
    "array<int>": lambda r: [r.randrange(9)],
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("descending", [False, True])
def test_bound_holds_for_every_rank(spark, kind, descending, monkeypatch):
    monkeypatch.setattr(bounds, "SMALL", 20)
    rng = random.Random(kind)
    values = [(None if rng.random() < 0.1 else KINDS[kind](rng), rng.randrange(50), i) for i in range(600)]
    df = spark.createDataFrame(values, f"x {kind}, y int, id int").repartition(3).cache()
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in ("x", "y", "id")]
    want = [r["id"] for r in df.orderBy(*keys).collect()]
    take = last_n if descending else first_n
    for n in (0, 1, 60, 333, 599, 600, 900):
        assert {r["id"] for r in take(df, ["x", "y", "id"], n).collect()} == set(want[:n])


def test_only_a_cell_more_is_ordered(spark):
    df = spark.range(200_000).select("id", (F.col("id") * 7919 % 199_999).alias("x"), F.lit(3).alias("same"))
    for order in (["x", "id"], ["same", "x", "id"]):
        for descending in (False, True):
            bound = bounds.leading_bound(df, order, 10, descending)
            assert 10 <= df.filter(bound).count() <= 10 + bounds.SMALL
    assert bounds.leading_bound(df, ["x"], 200_001) is None


def test_bound_reaches_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    bound = bounds.leading_bound(events, ["ts", "event_id"], 10, descending=True)
    plan = events.filter(bound)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan" in plan[plan.index("PushedFilters") :].split("]")[0]


def test_group_limits_stand_before_the_shuffle(spark):
    from tests.test_ordering import _skewed

    rows, frame = _skewed(spark)
    out = last_n(frame, ["at", "id"], 3, by=["client"])
    assert out.count() == sum(min(3, sum(r[1] == c for r in rows)) for c in {r[1] for r in rows})

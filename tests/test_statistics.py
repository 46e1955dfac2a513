import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packetloom.operators import evaluation as E
from packetloom.operators import statistics as S
from packetloom.operators.percentiles import (
    LINEAR,
    RANK,
    approx_percentile,
    exact_percentiles,
    grouped_percentiles,
)


def _values(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double")


def _pairs(spark, true, pred):
    return spark.createDataFrame(list(zip(true, pred)), "t int, p int")


def test_latency_worked_answers(spark):
    row = S.latency_stats(_values(spark, range(10, 101, 10)), "v").first()
    assert (row["p50"], row["p95"], row["p99"], row["mean"]) == pytest.approx((55, 95.5, 99.1, 55))
    assert row["std"] == pytest.approx(np.std(np.arange(10, 101, 10)))
    assert S.percentile(_values(spark, range(1, 101)), "v", 50).first()[0] == 50.5
    assert S.percentile(_values(spark, range(1, 101)), "v", 95).first()[0] == pytest.approx(95.05)
    assert S.latency_stats(_values(spark, [10, -5, 20]), "v").first()["samples"] == 2


def test_empty_statistics_are_zero(spark):
    empty = _values(spark, [])
    row = S.latency_stats(empty, "v").first()
    assert set(row.asDict().values()) == {0}
    assert S.percentile(empty, "v", 95).first()[0] == 0
    assert approx_percentile(empty, "v", 0.5).first()[0] == 0
    gauge = S.gauge_summary(empty, "v").first()
    assert (gauge["peak"], gauge["mean"]) == (0, 0)


def test_gauge(spark):
    row = S.gauge_summary(_values(spark, [100, 150, 200, 250, 300]), "v").first()
    assert (row["peak"], row["mean"]) == (300, 200)


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.integers(0, 30), min_size=1, max_size=60),
    st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0]), min_size=1, max_size=3, unique=True),
)
def test_percentiles_equal_numpy(spark, values, ps):
    frame = _values(spark, values)
    ordered = sorted(values)
    linear = exact_percentiles(frame, "v", ps, LINEAR).first()
    rank = exact_percentiles(frame, "v", ps, RANK).first()
    for i, p in enumerate(sorted(ps)):
        assert linear[i] == pytest.approx(np.percentile(values, p * 100))
        assert rank[i] == ordered[min(int(len(values) * p), len(values) - 1)]


def test_percentiles_of_many_values_with_coarse_sketch(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.exponential(10, 20_000).round(3), np.full(9_000, 7.5)])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    want = [np.percentile(values, q) for q in (5, 50, 95)]
    got = exact_percentiles(frame, "v", (0.05, 0.5, 0.95), LINEAR, accuracy=100).first()
    assert list(got) == pytest.approx(want)


def test_grouped_percentiles_with_one_hot_group(spark):
    rows = [("hot", float(i % 700)) for i in range(3000)] + [("cold", 1.0), ("cold", 3.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["p50"] for r in grouped_percentiles(frame, ["g"], "v", (0.5,), LINEAR).collect()}
    assert got == {"hot": np.percentile([i % 700 for i in range(3000)], 50), "cold": 2.0}


@pytest.mark.parametrize(
    ("true", "pred", "want"),
    [
        ([0, 0, 1, 1], [0, 0, 1, 1], 0.0),
        ([0, 0, 1, 1], [0, 1, 1, 1], 0.5),
        ([1, 2, 3], [1, 0, 3], 0.0),
        ([0, 0, 0, 0, 0], [0, 0, 0, 1, 2], 0.4),
    ],
)
def test_false_positive_rate(spark, true, pred, want):
    pairs = _pairs(spark, true, pred)
    assert E.false_positive_rate(pairs, "t", "p").first()[0] == pytest.approx(want)
    assert E.classification_metrics(pairs, "t", "p").first()["fpr"] == pytest.approx(want)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=40))
def test_macro_scores_against_counting(spark, pairs):
    row = E.classification_metrics(_pairs(spark, *zip(*pairs)), "t", "p").first()
    classes = {t for t, _ in pairs} | {p for _, p in pairs}
    f1 = []
    for c in classes:
        tp = sum(t == p == c for t, p in pairs)
        f1.append(2 * tp / (sum(t == c for t, _ in pairs) + sum(p == c for _, p in pairs)))
    assert row["f1_macro"] == pytest.approx(sum(f1) / len(f1))
    assert row["accuracy"] == pytest.approx(sum(t == p for t, p in pairs) / len(pairs))


def test_accuracy_worked_answer(spark):
    pairs = _pairs(spark, [0, 0, 0, 1, 1, 1, 2, 2, 2], [0, 0, 1, 1, 1, 0, 2, 2, 2])
    assert E.classification_metrics(pairs, "t", "p").first()["accuracy"] == pytest.approx(7 / 9)


def test_report_lists_absent_classes(spark):
    rows = E.classification_report(_pairs(spark, [0, 0], [0, 0]), "t", "p").orderBy("class").collect()
    assert [r["support"] for r in rows] == [2, 0, 0, 0, 0]
    assert rows[0]["f1"] == 1


def test_weights_and_ratio(spark):
    frame = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "c string")
    weights = {(r["c"], r["weight"]) for r in E.balanced_weights(frame, "c").collect()}
    assert weights == {("a", 8 / 12), ("b", 2.0)}
    assert E.imbalance_ratio(frame, "c").first()[0] == 3
    assert E.imbalance_ratio(frame.filter("c = 'a'"), "c").first()[0] == 1


@pytest.mark.parametrize(("size", "want"), [(100, [100] * 10), (250, [250] * 4), (300, [300, 300, 300, 100]), (333, [333, 333, 333, 1])])
def test_batch_slices(spark, size, want):
    rows = S.batch_counts(spark.range(1000), size).orderBy("batch").collect()
    assert [r["rows"] for r in rows] == want


@pytest.mark.parametrize(
    ("p95", "fpr", "fps", "want"),
    [(45, 0.015, 150000, True), (55, 0.015, 150000, False), (45, 0.025, 150000, False), (45, 0.015, 50000, False)],
)
def test_targets(spark, p95, fpr, fps, want):
    frame = spark.createDataFrame(
        [(float(p95), fpr, float(fps), 0.5)], "p95_latency_ms double, fpr double, throughput_fps double, f1_macro double"
    )
    row = S.target_status(frame).first()
    assert row["meets_targets"] is want
    assert row["f1_macro_ok"] is False


def test_throughput(spark):
    frame = spark.createDataFrame([(0, i) for i in (0, 10)], "g int, s int").selectExpr(
        "timestamp_seconds(s) as ts"
    )
    assert S.throughput(frame, "ts").first()[0] == pytest.approx(0.2)
    assert S.throughput(frame.limit(1), "ts").first()[0] == 0
    assert S.throughput(frame.limit(0), "ts").first()[0] == 0


def test_histogram_of_equal_values(spark):
    rows = S.histogram(_values(spark, [3, 3, 3]), "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [3, 0, 0, 0, 0]


def test_class_weights_leave_the_rows_in_place(spark):
    frame = spark.range(3000).selectExpr("id", "id % 3 as c", "array(id) as x").repartition(3)
    plan = E.balanced_weights(frame, "c")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan

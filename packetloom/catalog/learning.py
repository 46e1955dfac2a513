"""Queries that train, score and explain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from packetloom.catalog.bindings import (
    CLEAN_FLOWS_SQL,
    SCORED_SQL,
    raw_flows,
    scored_flows,
    table,
)
from packetloom.catalog.cleaning import joined, violations_sql
from packetloom.catalog.registry import query
from packetloom.functions.alerts import alert_id
from packetloom.functions.labels import encode_label, map_labels
from packetloom.operators.batches import map_batches
from packetloom.operators.explain import IMPORTANCE, explain_flows, top_importances
from packetloom.operators.features import engineer_features
from packetloom.operators.model import (
    BOOSTED,
    FOREST,
    FlowModel,
    boosted_margins,
    fit_classifier,
    load_model,
    save_model,
    score_flows,
    train_classifier,
)
from packetloom.operators.validation import validate_features
from packetloom.plans.detection import detect
from packetloom.plans.evaluation import score_table
from packetloom.schemas import FEATURES, LABELS, NON_NEGATIVE
from packetloom.session import scratch_path, written

_SMALL = {FOREST: dict(rounds=10, depth=5), BOOSTED: dict(rounds=4, depth=3)}


def _vectors(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", (F.col("label") % 5).alias("y"), "embedding")


def _train(spark, d, algorithm):
    return train_classifier(
        _vectors(spark, d), "vec_id", "y", "embedding", algorithm=algorithm, **_SMALL[algorithm]
    )


def flow_model(spark, d, algorithm=FOREST) -> FlowModel:
    """A model of the flow table: categories from the 30 features."""
    flows = engineer_features(raw_flows(spark, d), keep=["flow_id", "Label"])
    rows = validate_features(flows, "valid").withColumn(
        "y", encode_label(map_labels(F.col("Label")))
    )
    fitted = fit_classifier(written(rows, "labelled"), "y", FEATURES, algorithm, **_SMALL[algorithm])
    return FlowModel(fitted, algorithm)


def _clean_flows(spark, d):
    flows = engineer_features(raw_flows(spark, d), keep=["flow_id", "ts"])
    return validate_features(flows, "valid")


# SQL cannot fit a model. What must hold for every row of a model's output is
# computed from that output; the twin names the rows from the tables.

VALID_SQL = (
    f"with {CLEAN_FLOWS_SQL}, checked as (select *, {violations_sql(NON_NEGATIVE, ())} as violations "
    "from clean), valid as (select * from checked where violations = '')"
)


def _holds(*names: str) -> str:
    return f"{VALID_SQL} select flow_id, {', '.join(f'true as {n}' for n in names)} from valid"


_TEST_ROWS_SQL = (
    "with c as (select label % 5 as y, count(*) as n from embeddings group by 1), "
    "q as (select y, n, floor(n * 0.2::double) as q, n * 0.2::double - floor(n * 0.2::double) as r from c), "
    "x as (select *, row_number() over (order by round(r, 9) desc, y) as place, "
    "(select ceil(sum(n) * 0.2::double) - sum(floor(n * 0.2::double)) from c) as missing from q), "
    "z as (select y, cast(q + case when place <= missing then 1 else 0 end as bigint) as quota from x)"
)


def _in_unit(*names: str):
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).between(0.0, 1.0)
    return out


def _metrics_hold(training):
    scores = training.metrics().select(
        _in_unit("accuracy", "precision_macro", "recall_macro", "f1_macro", "fpr").alias("in_bounds")
    )
    tested = training.scored_test.agg(F.count(F.lit(1)).alias("n")).scalar()
    return scores.select(tested.alias("test_rows"), "in_bounds")


_METRICS_SQL = f"{_TEST_ROWS_SQL} select cast(sum(quota) as bigint) as test_rows, true as in_bounds from z"


@query("j3_train_forest", _METRICS_SQL)
def _(spark, d):
    return _metrics_hold(_train(spark, d, FOREST))


@query("j3_train_boosted", _METRICS_SQL)
def _(spark, d):
    return _metrics_hold(_train(spark, d, BOOSTED))


@query(
    "j3_training_report",
    f"{_TEST_ROWS_SQL} select cast(y as int) as class, "
    + "case y "
    + " ".join(f"when {i} then '{n}'" for i, n in enumerate(LABELS))
    + " end as label, quota as support, true as in_bounds from z",
)
def _(spark, d):
    report = _train(spark, d, FOREST).report()
    return report.select(
        "class", "label", "support", _in_unit("precision", "recall", "f1").alias("in_bounds")
    )


def _score_holds(scored):
    values = F.map_values("probabilities")
    total = F.aggregate(values, F.lit(0.0), lambda a, p: a + p)
    return scored.select(
        "flow_id",
        (F.abs(total - 1.0) < 1e-9).alias("sums_to_one"),
        (F.array_max(values) == F.col("confidence")).alias("largest_is_confidence"),
        (F.col("probabilities")[F.col("prediction")] == F.col("confidence")).alias("of_prediction"),
    )


_SCORE_SQL = _holds("sums_to_one", "largest_is_confidence", "of_prediction")


@query("j4_score_flows_forest", _SCORE_SQL)
def _(spark, d):
    return _score_holds(score_flows(flow_model(spark, d), _clean_flows(spark, d)))


@query("j4_score_flows_boosted", _SCORE_SQL)
def _(spark, d):
    return _score_holds(score_flows(flow_model(spark, d, BOOSTED), _clean_flows(spark, d)))


@query("a8_save_and_load_model", _holds("same_prediction", "same_confidence"))
def _(spark, d):
    model = flow_model(spark, d)
    path = save_model(model, scratch_path(spark, "model"), spark)
    flows = _clean_flows(spark, d)
    fresh = score_flows(model, flows).select("flow_id", "prediction", "confidence")
    loaded = score_flows(load_model(path, spark), flows).select(
        "flow_id", F.col("prediction").alias("p"), F.col("confidence").alias("c")
    )
    return fresh.join(loaded, "flow_id").select(
        "flow_id",
        (F.col("p") == F.col("prediction")).alias("same_prediction"),
        (F.col("c") == F.col("confidence")).alias("same_confidence"),
    )


@query(
    "g3_top_importances",
    "select cast(r as int) as rank, true as in_order, true as is_share from range(1, 11) t(r)",
)
def _(spark, d):
    top = top_importances(spark, flow_model(spark, d), 10)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("importance").desc(), F.col("index").desc())
    before = F.lag("importance").over(order)
    return top.select(
        F.row_number().over(order).alias("rank"),
        F.coalesce(before >= F.col("importance"), F.lit(True)).alias("in_order"),
        F.col("importance").between(0.0, 1.0).alias("is_share"),
    )


def _attribution_sum():
    values = F.transform("top_features", lambda f: f["importance"])
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) + F.col("base_value")


def _descending():
    sizes = F.transform("top_features", lambda f: f["abs_importance"])
    return F.reverse(F.array_sort(sizes)) == sizes


_SHAPLEY_SQL = _holds("adds_up", "largest_first")


@query("j6_shapley_forest", _SHAPLEY_SQL)
def _(spark, d):
    model = flow_model(spark, d)
    scored = score_flows(model, _clean_flows(spark, d))
    return explain_flows(model, scored, k=len(FEATURES), attacks_only=False).select(
        "flow_id",
        (F.abs(_attribution_sum() - F.col("confidence")) < 1e-6).alias("adds_up"),
        _descending().alias("largest_first"),
    )


@query("j6_shapley_boosted", _SHAPLEY_SQL)
def _(spark, d):
    model = flow_model(spark, d, BOOSTED)
    scored = boosted_margins(model, score_flows(model, _clean_flows(spark, d)))
    margin = F.get("margins", F.col("prediction_id"))
    return explain_flows(model, scored, k=len(FEATURES), attacks_only=False).select(
        "flow_id",
        (F.abs(_attribution_sum() - margin) < 1e-6).alias("adds_up"),
        _descending().alias("largest_first"),
    )


@query("j7_importance_fallback", _holds("same_as_global", "fallback", "no_error"))
def _(spark, d):
    model = flow_model(spark, d)
    scored = score_flows(model, _clean_flows(spark, d))
    best = [r["feature"] for r in top_importances(spark, model, 3).collect()]
    found = explain_flows(model, scored, method=IMPORTANCE, attacks_only=False)
    return found.select(
        "flow_id",
        (F.transform("top_features", lambda f: f["feature"]) == F.lit(best)).alias("same_as_global"),
        "fallback",
        F.col("error").isNull().alias("no_error"),
    )


def _stamped(spark, d):
    raw = raw_flows(spark, d).drop("ts", "flow_duration")
    return raw.join(
        scored_flows(spark, d).select("flow_id", "timestamp", "src_ip", "dst_ip"), "flow_id"
    )


@query("k1_detect_alerts", _holds("one_alert_per_attack", "right_severity", "right_features"))
def _(spark, d):
    found = detect(_stamped(spark, d), flow_model(spark, d))
    alerts = found.alerts().withColumnRenamed("id", "alert")
    flows = found.scored.select(
        "flow_id", "prediction", F.col("confidence").alias("c"), alert_id(F.col("flow_id"), F.col("ts")).alias("alert")
    )
    counted = flows.join(alerts, "alert", "left").groupBy("flow_id", "prediction", "c").agg(
        F.count("attack_type").alias("n"),
        F.min("severity").alias("severity"),
        F.min(F.size("top_3_features")).alias("features"),
    )
    attack = F.col("prediction") != "Normal"
    level = F.when(F.col("c") > 0.8, "high").otherwise("medium")
    return counted.select(
        "flow_id",
        (F.col("n") == attack.cast("int")).alias("one_alert_per_attack"),
        F.coalesce(F.col("severity") == level, ~attack).alias("right_severity"),
        F.coalesce(F.col("features") == 3, ~attack).alias("right_features"),
    )


@query(
    "k4_event_records",
    VALID_SQL.replace(" as violations from clean)", " as violations from clean join ips using (flow_id))")
    .replace("with flows", f"with {SCORED_SQL}, ips as (select flow_id, src_ip, dst_ip from scored), flows", 1)
    + " select src_ip, dst_ip, count(*) as events, true as features_complete, true as alerts_match from valid group by 1, 2",
)
def _(spark, d):
    events = detect(_stamped(spark, d), flow_model(spark, d), method=IMPORTANCE).events()
    alert = F.col("alert")
    fits = alert.isNull() | (
        (alert["attack_type"] != "Normal") & (alert["src_ip"] == F.col("src_ip")) & (alert["timestamp"] == F.col("timestamp"))
    )
    return events.groupBy("src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("events"),
        F.bool_and(F.size("flow_features") == len(FEATURES)).alias("features_complete"),
        F.bool_and(fits).alias("alerts_match"),
    )


@query(
    "b12_rejected_of_evaluation",
    f"with {CLEAN_FLOWS_SQL}, checked as (select flow_id, {violations_sql(NON_NEGATIVE, ())} as violations "
    "from clean) select * from checked where violations <> ''",
)
def _(spark, d):
    return joined(score_table(flow_model(spark, d), raw_flows(spark, d), keep=["flow_id"]).rejected)


@query(
    "l1_map_batches",
    f"with {SCORED_SQL} select flow_id, prediction, round(latency_ms * 2, 6) as twice from scored",
)
def _(spark, d):
    def double(rows):
        rows["twice"] = (rows["latency_ms"] * 2).round(6)
        return rows[["flow_id", "prediction", "twice"]]

    flows = scored_flows(spark, d).select("flow_id", "prediction", "latency_ms")
    return map_batches(flows, double, "flow_id long, prediction string, twice double", 1_000)

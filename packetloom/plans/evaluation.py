"""Evaluation of a model on a labelled table: scan, features, scores, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.labels import encode_label, map_labels
from packetloom.operators.evaluation import classification_metrics, classification_report
from packetloom.operators.features import engineer_features, strip_headers
from packetloom.operators.model import FlowModel, ModelMissing, score_flows
from packetloom.operators.statistics import attack_distribution
from packetloom.operators.validation import validate_features
from packetloom.schemas import LABEL_COLUMN
from packetloom.session import written
from packetloom.sources.csv import read_flows_csv


@dataclass
class Scored:
    """Scored rows, and the rows that broke a rule with their violations."""

    rows: DataFrame
    rejected: DataFrame


def score_table(model: FlowModel, raw: DataFrame, keep: Sequence[str] = ()) -> Scored:
    """Scores of a raw table, with ``y_true`` where it has labels. Broken rows
    cannot be scored; they are returned beside the others."""
    if model is None:
        raise ModelMissing("model is not trained or loaded")
    raw = strip_headers(raw)
    labelled = LABEL_COLUMN in raw.columns
    kept = [*keep, *([LABEL_COLUMN] if labelled else [])]
    features = engineer_features(raw, keep=kept)
    scored = score_flows(model, validate_features(features, "valid"))
    if labelled:
        scored = scored.withColumn("y_true", encode_label(map_labels(F.col(LABEL_COLUMN))))
    return Scored(scored, validate_features(features, "quarantine"))


def evaluate_csv(
    spark: SparkSession, model: FlowModel, path: str, max_rows: int | None = None
) -> dict[str, DataFrame]:
    """Quality, per-class report and distribution of a labelled CSV, with its
    rejected rows. ``max_rows`` looks at the first rows of the file only.

    The scores are written once, so that the model runs once for all results.
    """
    raw = read_flows_csv(spark, path)
    if max_rows is not None:
        raw = raw.limit(max_rows)
    found = score_table(model, raw)
    kept = [c for c in ("y_true", "prediction_id", "prediction") if c in found.rows.columns]
    scored = written(found.rows.select(*kept), "scored")
    out = {"attack_distribution": attack_distribution(scored), "rejected": found.rejected}
    if "y_true" in scored.columns:
        out["metrics"] = classification_metrics(scored, "y_true", "prediction_id")
        out["report"] = classification_report(scored, "y_true", "prediction_id", model.labels)
    return out

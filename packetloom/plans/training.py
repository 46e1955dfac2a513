"""Training from labelled raw tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.labels import encode_label, map_labels
from packetloom.operators.features import engineer_features, feature_array, require_columns
from packetloom.operators.model import Training, save_model, train_classifier
from packetloom.operators.ordering import with_rank
from packetloom.operators.validation import validate_features
from packetloom.schemas import FEATURES, LABEL_COLUMN
from packetloom.session import written
from packetloom.sources.csv import read_flows_csv


@dataclass
class Labelled:
    """Rows fit for training, and those that broke a rule."""

    rows: DataFrame
    rejected: DataFrame


def training_rows(raw: DataFrame, invalid: str = "valid") -> Labelled:
    """Features ``x``, class id ``y`` and a row key of a labelled table.

    The key is the hash of features and class with the number of equal rows
    before it, so it does not depend on how files are cut. The table is written
    once. ``invalid='fail'`` stops at the first broken row instead of setting
    it aside.
    """
    require_columns(raw, LABEL_COLUMN)
    rows = engineer_features(raw, keep=[LABEL_COLUMN])
    checked = validate_features(rows, "fail" if invalid == "fail" else "valid")
    y = encode_label(map_labels(F.col(LABEL_COLUMN)))
    plain = checked.select(y.alias("y"), feature_array().alias("x"))
    keyed = plain.withColumn("h", F.hex(F.xxhash64("y", "x")))
    numbered = with_rank(keyed, ["y"], ["h"], name="n")
    key = F.concat_ws("-", "h", F.col("n").cast("string")).alias("row_key")
    return Labelled(
        written(numbered.select(key, "y", "x"), "labelled"), validate_features(rows, "quarantine")
    )


def train_from_csv(
    spark: SparkSession, path: str, output: str | None = None, invalid: str = "valid", **options
) -> Training:
    """Read, clean, label, train; save the model when ``output`` is given."""
    labelled = training_rows(read_flows_csv(spark, path), invalid)
    training = train_classifier(labelled.rows, "row_key", "y", "x", **options)
    training.rejected = labelled.rejected
    training.model.feature_names = list(FEATURES)
    if output:
        save_model(training.model, output, spark)
    return training

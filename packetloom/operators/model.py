"""Training, scoring and keeping the attack classifier (Spark ML)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml.classification import (
    GBTClassifier,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.alerts import argmax_index
from packetloom.operators.balance import smote, stratified_split
from packetloom.operators.evaluation import (
    balanced_weights,
    classification_metrics,
    classification_report,
    imbalance_ratio,
)
from packetloom.operators.features import settled
from packetloom.schemas import FEATURES, LABELS
from packetloom.session import scratch_path, written

FOREST = "random_forest"
BOOSTED = "gbt_ovr"
_VECTOR = "_features"


class ModelMissing(ValueError):
    """A model is needed but was neither trained nor loaded."""


@dataclass
class FlowModel:
    """A fitted classifier and what is needed to read its output."""

    model: object
    algorithm: str
    labels: Sequence[str] = LABELS
    feature_names: Sequence[str] = FEATURES
    scale_pos_weight: float = 1.0
    path: str | None = field(default=None, compare=False)


def _features(df: DataFrame, features: str | Sequence[str]) -> Column:
    """The feature array of a row."""
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(f).cast("double") for f in features])


def with_vector(df: DataFrame, features: str | Sequence[str]) -> DataFrame:
    if isinstance(features, str):
        return df.withColumn(_VECTOR, array_to_vector(_features(df, features)))
    return VectorAssembler(
        inputCols=list(features), outputCol=_VECTOR, handleInvalid="keep"
    ).transform(df)


def fit_classifier(
    df: DataFrame,
    label: str,
    features: str | Sequence[str] = FEATURES,
    algorithm: str = BOOSTED,
    weight: str | None = None,
    rounds: int = 200,
    depth: int = 8,
    step: float = 0.1,
    row_share: float = 0.8,
    feature_share: str | None = None,
    seed: int = 42,
    parallelism: int = 5,
) -> object:
    """Fit on rows whose label is a class id 0..n-1."""
    rows = with_vector(df, features)
    common = dict(featuresCol=_VECTOR, labelCol=label, seed=seed, maxDepth=depth)
    if algorithm == FOREST:
        estimator = RandomForestClassifier(
            numTrees=rounds,
            subsamplingRate=row_share,
            featureSubsetStrategy=feature_share or "auto",
            **common,
        )
        if weight:
            estimator = estimator.setWeightCol(weight)
        return estimator.fit(rows)
    if algorithm == BOOSTED:
        base = GBTClassifier(
            maxIter=rounds,
            stepSize=step,
            subsamplingRate=row_share,
            featureSubsetStrategy=feature_share or "0.8",
            **common,
        )
        one = OneVsRest(
            classifier=base, featuresCol=_VECTOR, labelCol=label, parallelism=parallelism
        )
        if weight:
            one = one.setWeightCol(weight)
        return one.fit(rows)
    raise ValueError(f"unknown algorithm: {algorithm}")


@dataclass
class Training:
    """A trained model with the scores of its held-out rows."""

    model: FlowModel
    scored_test: DataFrame
    #: rows of the source that broke a rule, where the caller checked them
    rejected: DataFrame | None = None

    def metrics(self) -> DataFrame:
        return classification_metrics(self.scored_test, "y_true", "prediction_id")

    def report(self) -> DataFrame:
        return classification_report(
            self.scored_test, "y_true", "prediction_id", self.model.labels
        )


def train_classifier(
    df: DataFrame,
    key: str,
    label: str,
    features: str | Sequence[str] = FEATURES,
    test_size: float = 0.2,
    use_smote: bool = True,
    labels: Sequence[str] = LABELS,
    seed: int = 42,
    **fit_options,
) -> Training:
    """Split by class, fill up small classes of the training part, weight rows
    by class, fit, and score the held-out part."""
    array = _features(df, features)
    rows = df.select(key, F.col(label).cast("int").alias("y_true"), array.alias("x"))
    split = written(stratified_split(rows, key, "y_true", test_size, seed), "split")
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    if use_smote:
        train = smote(train, key, "y_true", "x")
    train = written(train.select("y_true", "x"), "train")
    scale = imbalance_ratio(train, "y_true").first()[0]
    weighted = balanced_weights(train, "y_true")
    algorithm = fit_options.pop("algorithm", BOOSTED)
    fitted = fit_classifier(
        weighted, "y_true", "x", algorithm, weight="weight", seed=seed, **fit_options
    )
    names = [] if isinstance(features, str) else list(features)
    model = FlowModel(fitted, algorithm, list(labels), names, float(scale))
    return Training(model, score_flows(model, test, "x"))


def score_flows(
    model: FlowModel | None, df: DataFrame, features: str | Sequence[str] = FEATURES
) -> DataFrame:
    """Add prediction, prediction_id, confidence and probabilities to rows.

    Everything stays in the JVM. For boosted models each class has its own
    binary margin m; its probability is 1/(1+exp(-2m)), scaled to sum to 1.
    """
    if model is None or model.model is None:
        raise ModelMissing("model is not trained or loaded")
    if model.algorithm == BOOSTED:
        scored, margins = _boosted_margins(model.model, with_vector(df, features))
        scored = settled(scored, {"_m": margins})
        odds = F.transform("_m", lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
        scored = settled(scored, {"_o": odds, "_at": argmax_index(F.col("_m"))})
        total = F.aggregate("_o", F.lit(0.0), lambda a, p: a + p)
        scored = settled(scored.withColumn("_t", total), {"_p": F.transform("_o", lambda p: p / F.col("_t"))})
    else:
        forest = model.model.copy()
        forest.setFeaturesCol(_VECTOR).setPredictionCol("")
        forest.setRawPredictionCol("").setProbabilityCol("_v")
        scored = forest.transform(with_vector(df, features))
        scored = settled(scored, {"_p": vector_to_array("_v")})
        scored = settled(scored, {"_at": argmax_index(F.col("_p"))})
    names = F.array(*[F.lit(n) for n in model.labels])
    return scored.select(
        *df.columns,
        F.col("_at").alias("prediction_id"),
        F.get(names, F.col("_at")).alias("prediction"),
        F.get("_p", F.col("_at")).alias("confidence"),
        F.map_from_arrays(F.slice(names, 1, F.size("_p")), F.col("_p")).alias("probabilities"),
    )


def boosted_margins(
    model: FlowModel, df: DataFrame, features: str | Sequence[str] = FEATURES
) -> DataFrame:
    """Add ``margins``: the raw score of every class of a boosted model."""
    scored, margins = _boosted_margins(model.model, with_vector(df, features))
    return scored.select(*df.columns, margins.alias("margins"))


def _boosted_margins(model: OneVsRestModel, df: DataFrame) -> tuple[DataFrame, Column]:
    margins = []
    for i, one in enumerate(model.models):
        one = one.copy()
        one.setFeaturesCol(_VECTOR).setPredictionCol("").setProbabilityCol("")
        df = one.setRawPredictionCol(f"_raw{i}").transform(df)
        margins.append(vector_to_array(f"_raw{i}")[1])
    return df, F.array(*margins)


# --- persistence ------------------------------------------------------------


def save_model(model: FlowModel, path: str, spark: SparkSession) -> str:
    """Write the model and, beside it, one row of metadata."""
    if model is None or model.model is None:
        raise ModelMissing("nothing to save")
    model.model.write().overwrite().save(f"{path}/model")
    meta = spark.createDataFrame(
        [
            (
                model.algorithm,
                list(model.labels),
                list(model.feature_names),
                float(model.scale_pos_weight),
            )
        ],
        "algorithm string, labels array<string>, feature_names array<string>, scale_pos_weight double",
    )
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    model.path = path
    return path


def load_model(path: str, spark: SparkSession) -> FlowModel:
    """Read a saved model; without metadata the defaults apply."""
    try:
        kind = spark.read.json(f"{path}/model/metadata").select("class").first()["class"]
    except AnalysisException as error:
        raise FileNotFoundError(f"model not found: {path}") from error
    boosted = kind.endswith("OneVsRestModel")
    reader = OneVsRestModel if boosted else RandomForestClassificationModel
    out = FlowModel(reader.load(f"{path}/model"), BOOSTED if boosted else FOREST, path=path)
    try:
        meta = spark.read.json(f"{path}/meta").first()
    except AnalysisException:
        return out
    out.labels = list(meta["labels"])
    out.feature_names = list(meta["feature_names"])
    out.scale_pos_weight = meta["scale_pos_weight"]
    return out


def saved_path(model: FlowModel, spark: SparkSession) -> str:
    """Where the model lies on disk; writes it to the shared folder if needed."""
    return model.path or save_model(model, scratch_path(spark, "model"), spark)

"""Why a flow was called an attack: tree Shapley values, or importances."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.alerts import top_attributions
from packetloom.functions.labels import is_attack
from packetloom.operators.model import BOOSTED, FlowModel, saved_path
from packetloom.schemas import ATTRIBUTION, FEATURES

SHAPLEY = "shapley"
IMPORTANCE = "importance"


@dataclass
class Leaf:
    """One leaf as a game over the features on its path.

    A feature inside its interval (low, high] keeps the full leaf value; a
    feature left out scales it by ``share``, the training weight that took the
    same branches.
    """

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    values: np.ndarray  # one per class


def _leaves(nodes: dict[int, dict]) -> list[Leaf]:
    out: list[Leaf] = []
    stack = [(0, {})]
    while stack:
        at, path = stack.pop()
        node = nodes[at]
        if node["left"] < 0:
            names = sorted(path)
            bounds = np.array([path[f] for f in names], dtype=float).reshape(-1, 3)
            out.append(
                Leaf(np.array(names, dtype=int), bounds[:, 0], bounds[:, 1], bounds[:, 2], node["values"])
            )
            continue
        feature, cut = node["feature"], node["threshold"]
        for child, is_left in ((node["left"], True), (node["right"], False)):
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            part = nodes[child]["cover"] / node["cover"] if node["cover"] else 0.0
            bound = (low, min(high, cut)) if is_left else (max(low, cut), high)
            stack.append((child, {**path, feature: (*bound, share * part)}))
    return out


def _pattern_values(share: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Shapley values of a unit leaf for the given patterns (rows of 0 and 1) of
    features in or out of their intervals: array (patterns, d)."""
    d = len(share)
    weight = np.array([1.0 / (d * math.comb(d - 1, s)) for s in range(d)])
    out = np.empty(inside.shape)
    for j in range(d):
        # coefficient s: sum over the coalitions of size s among the others
        poly = np.zeros((len(inside), d))
        poly[:, 0] = 1.0
        for i in range(d):
            if i == j:
                continue
            grown = poly * share[i]
            grown[:, 1:] += poly[:, :-1] * inside[:, i : i + 1]
            poly = grown
        out[:, j] = (inside[:, j] - share[j]) * (poly @ weight)
    return out


class TreeEnsemble:
    """The leaves of all trees that vote on each class."""

    def __init__(self, per_class: list[list[Leaf]], shared: bool):
        # shared: all classes use the same trees and differ in leaf values
        self.per_class = per_class
        self.shared = shared

    def plain(self) -> tuple[list, bool]:
        """The ensemble as bare arrays, for a broadcast."""
        return [[astuple(leaf) for leaf in leaves] for leaves in self.per_class], self.shared

    @classmethod
    def of(cls, plain: tuple[list, bool]) -> TreeEnsemble:
        per_class, shared = plain
        return cls([[Leaf(*leaf) for leaf in leaves] for leaves in per_class], shared)

    @property
    def classes(self) -> int:
        return len(self.per_class[0][0].values) if self.shared else len(self.per_class)

    def _of(self, c: int) -> tuple[list[Leaf], int]:
        return (self.per_class[0], c) if self.shared else (self.per_class[c], 0)

    def base_value(self, c: int) -> float:
        leaves, at = self._of(c)
        return float(sum(leaf.values[at] * np.prod(leaf.share) for leaf in leaves))

    def attributions(self, x: np.ndarray, c: int) -> np.ndarray:
        """Shapley values (rows, features) of class ``c``."""
        leaves, at = self._of(c)
        out = np.zeros(x.shape)
        for leaf in leaves:
            d = len(leaf.features)
            value = leaf.values[at]
            if d == 0 or value == 0.0:
                continue
            part = x[:, leaf.features]
            hit = (part > leaf.low) & (part <= leaf.high)
            # only patterns that occur: at most one per row, however deep the tree
            patterns, which = np.unique(hit, axis=0, return_inverse=True)
            each = _pattern_values(leaf.share, patterns.astype(float))
            out[:, leaf.features] += value * each[which.ravel()]
        return out


def _tree_nodes(rows, classes: int | None, scale: dict[int, float]) -> dict[int, dict[int, dict]]:
    trees: dict[int, dict[int, dict]] = {}
    for row in rows:
        node, stats = row["nodeData"], list(row["nodeData"]["impurityStats"])
        cover = sum(stats) if classes else stats[0]
        if classes:
            values = np.array(stats) / cover if cover else np.zeros(classes)
        else:
            values = np.array([node["prediction"]])
        trees.setdefault(row["treeID"], {})[node["id"]] = {
            "left": node["leftChild"],
            "right": node["rightChild"],
            "feature": node["split"]["featureIndex"],
            "threshold": (node["split"]["leftCategoriesOrThreshold"] or [0.0])[0],
            "cover": cover,
            "values": values * scale[row["treeID"]],
        }
    return trees


def load_ensemble(spark: SparkSession, model: FlowModel) -> TreeEnsemble:
    """Read the trees of a saved model. They fit on the driver: that is where
    the model was built."""
    path = f"{saved_path(model, spark)}/model"
    if model.algorithm == BOOSTED:
        per_class = []
        for i in range(len(model.model.models)):
            weights = {
                r[0]: r[1]
                for r in spark.read.parquet(f"{path}/model_{i}/treesMetadata")
                .select("_1", "_3")
                .collect()
            }
            rows = spark.read.parquet(f"{path}/model_{i}/data").collect()
            trees = _tree_nodes(rows, None, weights)
            per_class.append([leaf for t in trees.values() for leaf in _leaves(t)])
        return TreeEnsemble(per_class, shared=False)
    forest = model.model
    rows = spark.read.parquet(f"{path}/data").collect()
    share = 1.0 / forest.getNumTrees
    trees = _tree_nodes(rows, forest.numClasses, {r["treeID"]: share for r in rows})
    return TreeEnsemble([[leaf for t in trees.values() for leaf in _leaves(t)]], shared=True)


def _explained(ensemble: TreeEnsemble, rows: pd.Series, classes: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(rows), dtype=object)
    known = classes.fillna(-1).astype(int).to_numpy()
    for c in np.unique(known):
        if not 0 <= c < ensemble.classes:
            continue
        where = np.flatnonzero(known == c)
        phi = ensemble.attributions(np.stack(rows.iloc[where].to_list()).astype(float), c)
        base = np.full((len(where), 1), ensemble.base_value(c))
        for i, values in zip(where, np.hstack([phi, base])):
            out.iat[i] = values
    return out


def shapley_column(spark: SparkSession, model: FlowModel, features: Column, class_id: Column) -> Column:
    """Per row: the attributions of all features, then the base value.

    Rows with a NULL or negative class are not explained. Only the feature
    array and the class travel to Python; the trees are sent once per executor.
    """
    shared = spark.sparkContext.broadcast(load_ensemble(spark, model).plain())

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def explain(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ensemble = TreeEnsemble.of(shared.value)
        for rows, classes in batches:
            yield _explained(ensemble, rows, classes)

    return explain(features, class_id)


def model_importances(model: FlowModel) -> list[float] | None:
    """Global feature importances; one-vs-rest models average their members."""
    members = getattr(model.model, "models", [model.model])
    found = [m.featureImportances.toArray() for m in members if hasattr(m, "featureImportances")]
    if not found:
        return None
    return [float(v) for v in np.mean(found, axis=0)]


def top_importances(spark: SparkSession, model: FlowModel, k: int = 3) -> DataFrame:
    """The ``k`` globally most important features; ties to the higher index."""
    values = model_importances(model) or []
    names = _names(model, len(values))
    rows = [(i, n, v) for i, (n, v) in enumerate(zip(names, values))]
    frame = spark.createDataFrame(rows, "index int, feature string, importance double")
    return frame.orderBy(F.col("importance").desc(), F.col("index").desc()).limit(k)


def _names(model: FlowModel, width: int) -> list[str]:
    names = list(model.feature_names)
    return names if len(names) == width else [f"f{i}" for i in range(width)]


_NO_ATTRIBUTIONS = T.ArrayType(ATTRIBUTION)


def explain_flows(
    model: FlowModel,
    scored: DataFrame,
    features: str | Sequence[str] = FEATURES,
    k: int = 3,
    method: str = SHAPLEY,
    class_id: Column | None = None,
    attacks_only: bool = True,
) -> DataFrame:
    """Add top_features, base_value and fallback to scored rows.

    The explained class is the predicted one unless ``class_id`` names another.
    With ``attacks_only`` normal rows stay unexplained (and cost nothing).
    """
    spark = scored.sparkSession
    values = (
        F.col(features).cast("array<double>")
        if isinstance(features, str)
        else F.array(*[F.col(f).cast("double") for f in features])
    )
    chosen = class_id if class_id is not None else F.col("prediction_id")
    wanted = is_attack(F.col("prediction")) if attacks_only else F.lit(True)
    importances = model_importances(model)
    if method == SHAPLEY:
        width = len(importances) if importances else len(FEATURES)
        phi = shapley_column(spark, model, values, F.when(wanted, chosen))
        out = scored.withColumn("_x", values).withColumn("_phi", phi)
        top = top_attributions(
            F.col("_x"), F.slice("_phi", 1, width), _names(model, width), k
        )
        return out.select(
            *scored.columns,
            F.when(F.col("_phi").isNotNull(), top).alias("top_features"),
            F.get("_phi", F.lit(width)).alias("base_value"),
            F.lit(False).alias("fallback"),
        )
    if method != IMPORTANCE:
        raise ValueError(f"unknown method: {method}")
    none = F.array().cast(_NO_ATTRIBUTIONS)
    if importances is None:
        top, error = none, F.lit("model has no feature importances")
    elif not isinstance(features, str) and len(importances) != len(features):
        top, error = none, F.lit("feature importances do not match the features")
    else:
        literal = F.array(*[F.lit(v) for v in importances])
        top = top_attributions(values, literal, _names(model, len(importances)), k)
        error = F.lit(None).cast("string")
    return scored.select(
        "*",
        F.when(wanted, top).alias("top_features"),
        F.lit(0.0).alias("base_value"),
        F.lit(True).alias("fallback"),
        error.alias("error"),
    )


def explain_alerts(model: FlowModel, scored: DataFrame, **options) -> DataFrame:
    """``explain_flows`` on the attack rows alone: they are selected first, so
    no other row reaches Python."""
    return explain_flows(model, scored.filter(is_attack(F.col("prediction"))), **options)

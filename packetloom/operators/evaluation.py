"""Class statistics and quality of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.values import ratio
from packetloom.schemas import LABELS
from packetloom.session import written


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent of every class."""
    # one row per class reaches the window
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return class_counts(df, label).withColumn("percent", ratio(F.col("count"), total) * 100)


def imbalance_ratio(df: DataFrame, label: str) -> DataFrame:
    """Largest class size over the smallest; 1 with fewer than two classes."""
    ratio_ = F.max("count") / F.min("count")
    return class_counts(df, label).agg(
        F.when(F.count(F.lit(1)) < 2, F.lit(1.0)).otherwise(ratio_).alias("imbalance_ratio")
    )


def class_set(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct classes over one or several label columns."""
    each = [df.select(F.col(c).alias("class")).distinct() for c in columns]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.distinct()


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Per row n / (k * n_class), with k the number of classes present.

    Class counts come from one pass over the label column. The table of weights is
    written, so that Spark knows its size: while classes are few it is broadcast, and
    the rows, with all their columns, stay where they are.
    """
    counts = class_counts(df, label)
    totals = counts.agg(F.struct(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    per_class = counts.select(
        F.col(label).alias("_class"),
        (totals["n"] / (totals["k"] * F.col("count"))).alias(name),
    )
    per_class = written(per_class, "weights")
    return df.join(per_class, F.col(label).eqNullSafe(F.col("_class"))).drop("_class")


def confusion_counts(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Rows per (true, predicted) pair: the one pass all scores come from."""
    return df.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def per_class_scores(confusion: DataFrame) -> DataFrame:
    """tp, support, predicted, precision, recall and F1 of every class seen."""
    zero = F.lit(0).cast("bigint")
    as_true = F.struct(
        F.col("y_true").alias("class"),
        F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero).alias("tp"),
        F.col("n").alias("support"),
        zero.alias("predicted"),
    )
    as_pred = F.struct(
        F.col("y_pred").alias("class"),
        zero.alias("tp"),
        zero.alias("support"),
        F.col("n").alias("predicted"),
    )
    return (
        confusion.select(F.inline(F.array(as_true, as_pred)))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
        .select(
            "*",
            ratio(F.col("tp"), F.col("predicted")).alias("precision"),
            ratio(F.col("tp"), F.col("support")).alias("recall"),
            ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        )
    )


def _fpr(negative) -> Column:
    is_negative = F.col("class") == F.lit(negative)
    support = F.sum(F.when(is_negative, F.col("support")))
    hits = F.sum(F.when(is_negative, F.col("tp")))
    return ratio(support - hits, support)


def classification_metrics(
    df: DataFrame, y_true: str, y_pred: str, negative=0
) -> DataFrame:
    """Accuracy, macro precision/recall/F1 and false-positive rate, one row.

    Macro values average over the classes that occur as true or predicted.
    """
    scores = per_class_scores(confusion_counts(df, y_true, y_pred))
    zero = F.lit(0.0)
    return scores.agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.coalesce(F.avg("precision"), zero).alias("precision_macro"),
        F.coalesce(F.avg("recall"), zero).alias("recall_macro"),
        F.coalesce(F.avg("f1"), zero).alias("f1_macro"),
        _fpr(negative).alias("fpr"),
    )


def false_positive_rate(df: DataFrame, y_true: str, y_pred: str, negative=0) -> DataFrame:
    """FP / (FP + TN); 0 without negative rows."""
    is_negative = F.col(y_true) == F.lit(negative)
    return df.agg(
        ratio(
            F.count_if(is_negative & (F.col(y_pred) != F.lit(negative))),
            F.count_if(is_negative),
        ).alias("fpr")
    )


def classification_report(
    df: DataFrame, y_true: str, y_pred: str, labels: Sequence[str] = LABELS
) -> DataFrame:
    """Scores of every category by id: of all in ``labels``, also those that never
    occur, and of ids beyond them, named by their number."""
    scores = per_class_scores(confusion_counts(df, y_true, y_pred)).withColumn(
        "class", F.col("class").cast("int")
    )
    vocabulary = df.sparkSession.createDataFrame(
        list(enumerate(labels)), "class int, label string"
    )
    joined = vocabulary.join(scores.filter(F.col("class").isNotNull()), "class", "full")
    return joined.select(
        "class",
        F.coalesce("label", F.col("class").cast("string")).alias("label"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
        F.coalesce(F.col("support"), F.lit(0)).alias("support"),
    )


def confusion_matrix(
    df: DataFrame, y_true: str, y_pred: str, classes: Sequence = tuple(range(len(LABELS)))
) -> DataFrame:
    """Counts with one row per true and one column per predicted class; a
    prediction outside ``classes`` counts as ``pred_other``."""
    known = F.col(y_pred).isin(list(classes))
    counts = [F.count_if(F.col(y_pred) == F.lit(c)).alias(f"pred_{c}") for c in classes]
    other = F.count_if(~F.coalesce(known, F.lit(False))).alias("pred_other")
    return df.groupBy(F.col(y_true).alias("y_true")).agg(*counts, other)

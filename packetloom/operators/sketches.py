"""Stored quantile sketches: one read of the rows, then percentiles of any span.

A row of the table holds the count, sum, extremes and a KLL sketch of one stretch of
time and one class. Sketches merge, so days, months or all classes together come from
the stored stretches alone. A sketch keeps some ``k`` values a level, whatever the
number of rows; partial sketches are made before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: values a sketch keeps; with 800 a rank is within half a percent of all rows
ACCURACY = 800
#: share of all rows by which the rank of a percentile may be off at that accuracy
RANK_ERROR = 0.005


def sketched(
    df: DataFrame, value: str, ts: str, by: Sequence[str] = (), unit: str = "hour", k: int = ACCURACY
) -> DataFrame:
    """``start`` (of the hour, or another ``unit``), ``by``, ``n``, ``total``, ``least``,
    ``most`` and ``sketch``. Values that are NULL or NaN do not count; rows without a
    time make a stretch of their own. An empty table gives no rows."""
    number = F.col(value).cast("double")
    rows = df.select(F.date_trunc(unit, ts).alias("start"), *by, number.alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return rows.groupBy("start", *by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_v").alias("total"),
        F.min("_v").alias("least"),
        F.max("_v").alias("most"),
        F.kll_sketch_agg_double("_v", k).alias("sketch"),
    )


def rolled_up(table: DataFrame, by: Sequence[str | Column] = (), k: int = ACCURACY) -> DataFrame:
    """The stretches of a sketch table merged by ``by``: columns of it, or of its ``start``."""
    return table.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.kll_merge_agg_double("sketch", k).alias("sketch"),
    )


def sketch_percentile(p: float) -> Column:
    """The value at rank ``p`` (0 to 1) of a sketch table's rows."""
    return F.kll_sketch_get_quantile_double(F.col("sketch"), F.lit(float(p)))


def write_sketches(table: DataFrame, path: str) -> None:
    """Store a sketch table by day; the days that it holds are replaced."""
    out = table.withColumn("day", F.to_date("start"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_sketches(
    spark: SparkSession, path: str, first: date | None = None, last: date | None = None
) -> DataFrame:
    """The stored stretches from day ``first`` to ``last``; other days are not read."""
    table = spark.read.parquet(path)
    if first is not None:
        table = table.filter(F.col("day") >= F.lit(first))
    if last is not None:
        table = table.filter(F.col("day") <= F.lit(last))
    return table.drop("day")

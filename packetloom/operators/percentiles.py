"""Exact percentiles without sorting, or collecting, the whole column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordering import running_totals

LINEAR = "linear"  # interpolate between the two nearest ranks
RANK = "rank"  # the element at floor(n * p), 0-based, at most the last


def percentile_name(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def _targets(p: float, n: Column, kind: str) -> tuple[Column, Column, Column]:
    """0-based lower rank, upper rank and the weight of the upper one."""
    last = n - F.lit(1)
    if kind == RANK:
        at = F.least(F.floor(n * F.lit(float(p))), last)
        return at, at, F.lit(0.0)
    if kind == LINEAR:
        exact = last * F.lit(float(p))
        low = F.floor(exact)
        return low, F.least(low + 1, last), exact - low
    raise ValueError(f"unknown percentile kind: {kind}")


def exact_percentiles(
    df: DataFrame,
    value: str,
    ps: Sequence[float],
    kind: str = LINEAR,
    accuracy: int = 10_000,
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row with an exact percentile column (``p95`` ...) for each of ``ps``.

    A sketch first gives a bracket around every percentile, some rows wide per
    ``accuracy`` rows. Outside the brackets rows are only counted; inside them
    equal values are merged, and just these few values are ordered, in buckets.
    Two passes over the rows; the first one gives the sketch and the count, and
    the aggregates ``also``, which become further columns of the result.
    """
    ps, also = sorted(ps), dict(also or {})
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    margin = 2.0 / accuracy
    edges = [e for p in ps for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    number = F.col(value).cast("double")
    passed = df.agg(
        F.percentile_approx(number, edges, accuracy).alias("_q"),
        F.count(number).alias("_n"),
        *[c.alias(k) for k, c in also.items()],
    )
    first = passed.first()
    n = first["_n"]
    cuts = F.lit(first["_q"] or [0.0] * len(edges)).cast("array<double>")

    # 2i+1 is the inside of bracket i; even zones lie between the brackets
    zone = F.when(F.lit(False), -1)
    for i in reversed(range(len(ps))):
        zone = zone.when(F.col("v") > F.col("q")[2 * i + 1], 2 * i + 2)
        zone = zone.when(F.col("v") >= F.col("q")[2 * i], 2 * i + 1)
    zone = zone.otherwise(0)
    inside = F.col("zone") % 2 == 1
    pieces = (
        rows.withColumn("q", cuts)
        .withColumn("zone", zone)
        .groupBy("zone", F.when(inside, F.col("v")).alias("at"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    ordered = running_totals(pieces, {"end": F.col("c")}, ["low"])
    ordered = ordered.withColumn("start", F.col("end") - F.col("c")).withColumn("n", F.lit(n))
    kinds = {f.name: f.dataType for f in passed.schema.fields}
    return ordered.agg(*[_pick(p, kind).alias(percentile_name(p)) for p in ps]).select(
        "*", *[F.lit(first[k]).cast(kinds[k]).alias(k) for k in also]
    )


def _pick(p: float, kind: str) -> Column:
    low, high, weight = _targets(p, F.col("n"), kind)
    a, b = F.max(_at_rank(low)), F.max(_at_rank(high))
    share = F.max(weight)
    return F.coalesce(F.when(share == 0, a).otherwise(a + (b - a) * share), F.lit(0.0))


def _at_rank(rank: Column) -> Column:
    """The value at a rank, when the rank falls into this piece."""
    start, end = F.col("start"), F.col("start") + F.col("c") - 1
    known = (
        F.when((F.col("low") == F.col("high")) | (rank == start), F.col("low"))
        .when(rank == end, F.col("high"))
        .otherwise(F.raise_error(F.lit("percentile outside its bracket: raise accuracy")))
    )
    return F.when(rank.between(start, end), known)


def grouped_percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    ps: Sequence[float],
    kind: str = RANK,
) -> DataFrame:
    """Exact percentiles of every group; a group of any size is spread out."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_at"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    totals = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, {"_end": F.col("c")}, ["_at"], by)
    pieces = ranked.join(totals, list(by)).select(
        *by,
        "n",
        "c",
        (F.col("_end") - F.col("c")).alias("start"),
        F.col("_at").alias("low"),
        F.col("_at").alias("high"),
    )
    return pieces.groupBy(*by).agg(*[_pick(p, kind).alias(percentile_name(p)) for p in ps])


def approx_percentile(df: DataFrame, value: str, p: float, accuracy: int = 10_000) -> DataFrame:
    """A percentile from a sketch: one pass, bounded memory."""
    return df.agg(
        F.coalesce(F.percentile_approx(value, p, accuracy), F.lit(0.0))
        .cast("double")
        .alias(percentile_name(p))
    )

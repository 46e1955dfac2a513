"""Splitting and balancing of labelled training rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.evaluation import class_counts
from packetloom.operators.neighbours import finite_rows, nearest_by_pivots, nearest_of_tiles
from packetloom.operators.ordering import (
    default_buckets,
    hash_cuts,
    hash_order,
    with_rank,
)
from packetloom.session import written

SMOTE_TARGET = 10_000
SMOTE_NEIGHBOURS = 5
_SLOT_PIECE = 10_000
#: numbers of a tile of rows whose neighbours are searched for: 32 MB
_TILE_NUMBERS = 4_000_000
#: rows of a table of classes that is broadcast
_FEW_CLASSES = 10_000


def known_classes(df: DataFrame, label: str) -> dict:
    """Class sizes on the driver: one number per class of a label column."""
    rows = class_counts(df.filter(F.col(label).isNotNull()), label).collect()
    return {r[label]: r["count"] for r in sorted(rows, key=lambda r: r[label])}


def _per_class(df: DataFrame, label: str, values: dict, name: str, kind: str) -> DataFrame:
    """A table of one value per class."""
    schema = T.StructType([T.StructField(label, df.schema[label].dataType)]).add(name, kind)
    return df.sparkSession.createDataFrame(list(values.items()), schema)


def _few(classes: DataFrame, count: int) -> DataFrame:
    """A table of classes, sent to all tasks while they are few: Spark does not know the
    size of a table made here, and would shuffle the rows that it is joined with."""
    return F.broadcast(classes) if count <= _FEW_CLASSES else classes


def split_quotas(sizes: dict, fraction: float) -> dict:
    """Test rows per class: the rounded-down share, and the rows still missing
    to the rounded-up total go to the largest remainders."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must be between 0 and 1")
    shares = {c: n * fraction for c, n in sizes.items()}
    quotas = {c: math.floor(s) for c, s in shares.items()}
    missing = math.ceil(sum(sizes.values()) * fraction) - sum(quotas.values())
    by_remainder = sorted(shares, key=lambda c: (-round(shares[c] - quotas[c], 9), c))
    for c in by_remainder[:missing]:
        quotas[c] += 1
    return quotas


def stratified_split(
    df: DataFrame, key: str, label: str, fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: in every class, the quota's worth of rows first in a
    seeded hash order of ``key``.

    Only the hash at which each class fills its quota is looked up; the rows
    themselves are then marked in place, without a shuffle.
    """
    quotas = split_quotas(known_classes(df, label), fraction)
    quota = _few(_per_class(df, label, {c: q for c, q in quotas.items() if q}, "quota", "long"), len(quotas))
    cuts = hash_cuts(df, key, seed, quota, [label]).select(
        F.col(label).alias("_class"), F.col("cut").alias("_cut")
    )
    marked = df.join(written(cuts, "cuts"), F.col(label) == F.col("_class"), "left")
    test = F.coalesce(hash_order(F.col(key), seed) <= F.col("_cut"), F.lit(False))
    return marked.withColumn("is_test", test).drop("_class", "_cut")


def _grid(rows: int, asked: int, most: int, least: int, tasks: int) -> tuple[int, int]:
    """Slices of the asked rows and tiles of all rows of a class. A tile or slice holds
    ``most`` rows at most; there are ``tasks`` pairs, unless they would hold fewer than
    ``least`` rows, and as few copies of rows as that takes."""
    slices, tiles = max(1, math.ceil(asked / most)), max(1, math.ceil(rows / most))
    while slices * tiles < tasks:
        more_slices, more_tiles = slices * least < asked, tiles * least < rows
        if more_slices and (rows <= 2 * asked or not more_tiles):
            slices += 1
        elif more_tiles:
            tiles += 1
        else:
            break
    return slices, tiles


def nearest_in_class(
    df: DataFrame,
    key: str,
    label: str,
    features: str,
    k: int = SMOTE_NEIGHBOURS,
    block_rows: int = 2_000,
    asked: str | None = None,
) -> DataFrame:
    """The exact ``k`` nearest other rows of the same class (squared Euclidean
    distance, ties to the smaller key): columns key, label, neighbour, distance,
    rank. ``asked`` names a column that marks the rows whose neighbours are wanted,
    else it is all.

    The rows of a class that ask are hashed into slices and all its rows into tiles. A
    task compares a slice with a tile and passes on only the ``k`` best per row. Tiles
    are as large as a task may hold (``_TILE_NUMBERS``), or smaller so that classes
    give enough tasks, down to about ``block_rows`` rows: a row is copied once for
    each slice and, if it asks, each tile, not once for every ``block_rows`` rows.
    """
    kind = df.schema[features].dataType
    short = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = df.filter(F.col(label).isNotNull()).select(
        key,
        label,
        (F.col(features) if short else F.col(features).cast("array<double>")).alias("_x"),
        (F.lit(True) if asked is None else F.coalesce(F.col(asked), F.lit(False))).alias("_asks"),
    )
    sizes = rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("_asks").alias("asked"), F.max(F.size("_x")).alias("width")
    )
    sizes = [r for r in sizes.collect() if r["asked"]]
    buckets = default_buckets(df)
    work = sum(r["rows"] * r["asked"] for r in sizes)
    grid = []
    for r in sorted(sizes, key=lambda r: r[label]):
        most = max(block_rows, _TILE_NUMBERS // max(1, r["width"] or 1))
        tasks = math.ceil(buckets * r["rows"] * r["asked"] / work)
        grid.append((r[label], *_grid(r["rows"], r["asked"], most, block_rows, tasks)))
    schema = T.StructType([T.StructField(label, df.schema[label].dataType)])
    cuts = df.sparkSession.createDataFrame(grid, schema.add("_slices", "integer").add("_tiles", "integer"))
    cuts = _few(cuts, len(grid))
    # more partitions than pairs: few pairs meet in one
    parts = max(buckets, min(2_000, 2 * sum(slices * tiles for _, slices, tiles in grid)))

    def dealt(part: DataFrame, own: str, other: str, count: str) -> DataFrame:
        others = F.explode(F.expr(f"sequence(0, {count} - 1)")).alias(other)
        dealt = part.join(cuts, label).select(key, label, "_x", own, others)
        return dealt.repartition(parts, label, "_slice", "_tile")

    # another part of the hash than the one that deals out shuffle partitions
    place = F.xxhash64(F.lit(7), key)
    left = dealt(rows.filter("_asks"), F.pmod(place, F.col("_slices")).cast("int").alias("_slice"), "_tile", "_tiles")
    right = dealt(rows, F.pmod(place, F.col("_tiles")).cast("int").alias("_tile"), "_slice", "_slices")
    return _best_of_tiles(left, right, key, label, k)


def _best_of_tiles(left: DataFrame, right: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """The ``k`` nearest ``right`` rows of every ``left`` row, over the pairs of a slice
    and a tile (label, _slice, _tile) that both have."""
    names = [key, label, "neighbour", "distance"]

    def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        a, b = finite_rows(mine), finite_rows(theirs)
        if not len(mine) or not len(theirs):
            return pd.DataFrame(columns=names)
        order = theirs[key].argsort(kind="stable").to_numpy()
        own, ids = mine[key].to_numpy(), theirs[key].to_numpy()[order]
        at, near, gap = nearest_of_tiles(own, a, ids, b[order], k)
        return pd.DataFrame({key: own[at], label: mine[label].iloc[0], "neighbour": near, "distance": gap})

    kind, classes = left.schema[key].dataType, left.schema[label].dataType
    schema = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField(label, classes),
            T.StructField("neighbour", kind),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    pair = [label, "_slice", "_tile"]
    # both sides come from one frame: fresh columns tell them apart
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    found = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(compare, schema)
    window = Window.partitionBy(label, key).orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def smote_plan(sizes: dict, target: int = SMOTE_TARGET, when_empty: str = "auto") -> tuple[dict, int]:
    """New rows per class, and the neighbour count.

    Classes with 2 <= rows < min(target, largest class) are filled up to it.
    When there is none, every class is filled up to the largest one, or, with
    ``when_empty='skip'``, nothing is added.
    """
    if not sizes:
        return {}, 1
    largest, smallest = max(sizes.values()), min(sizes.values())
    goal = min(target, largest)
    extra = {c: goal - n for c, n in sizes.items() if 2 <= n < goal}
    if not extra and when_empty == "auto":
        extra = {c: largest - n for c, n in sizes.items() if 2 <= n < largest}
    return extra, max(1, min(SMOTE_NEIGHBOURS, smallest - 1))


def synthetic_rows(
    df: DataFrame,
    key: str,
    label: str,
    features: str,
    extra: dict,
    k: int,
    seed: int = 0,
    neighbours: str = "exact",
) -> DataFrame:
    """``extra[class]`` new rows per class, each on the line between a row and
    one of its ``k`` nearest neighbours: columns label, slot, features.

    Everything about a new row follows from its class and slot number, so a
    lost task recomputes the same rows.
    """
    sizes = known_classes(df, label)
    classes = [c for c in sorted(extra) if extra[c] > 0]
    spark = df.sparkSession
    kind = df.schema[label].dataType
    integral = isinstance(kind, T.IntegralType)
    # slots ask for the rows (slot + seed) % n of a class in the order of keys: for those
    # from one key to another, around the end
    table = [
        (c, extra[c], sizes[c], c if integral else i, (1 + seed) % sizes[c], (extra[c] + seed) % sizes[c])
        for i, c in enumerate(classes)
    ]
    schema = T.StructType([T.StructField(label, kind)])
    for name in ("_extra", "_n", "_code", "_first_at", "_last_at"):
        schema = schema.add(name, "long")
    wanted = spark.createDataFrame(table, schema)
    few = _few(wanted, len(table))
    rows = df.join(few.select(label), label, "left_semi").select(key, label, features)
    # slots 1.._extra of every class, in pieces, so that a large class is spread
    pieces = wanted.withColumn(
        "_first", F.explode(F.expr(f"sequence(1L, _extra, {_SLOT_PIECE}L)"))
    ).repartition(label, "_first")
    slots = pieces.withColumn(
        "slot", F.explode(F.expr(f"sequence(_first, least(_extra, _first + {_SLOT_PIECE - 1}))"))
    )
    code = F.col("_code")
    slots = slots.select(
        label,
        "slot",
        F.pmod(F.col("slot") + seed, F.col("_n")).alias("_at"),
        (F.pmod(F.col("slot") * 7919 + code * 104729 + seed, F.lit(k)) + 1).alias("_rank"),
        (F.pmod(F.col("slot") * 15485863 + code * 32452843 + seed, F.lit(1000)) / 1000.0).alias("_u"),
    )
    at = (F.col("_pos") - 1).alias("_at")
    numbered = with_rank(rows.select(key, label), [key], [label], name="_pos").select(key, label, at)
    if neighbours == "exact":
        ends = numbered.join(few, label).groupBy(label, "_extra", "_n", "_first_at", "_last_at").agg(
            F.max(F.when(F.col("_at") == F.col("_first_at"), F.col(key))).alias("_from"),
            F.max(F.when(F.col("_at") == F.col("_last_at"), F.col(key))).alias("_upto"),
        )
        ends = _few(written(ends, "ends"), len(table))
        after, before = F.col(key) >= F.col("_from"), F.col(key) <= F.col("_upto")
        asks = F.when(F.col("_extra") >= F.col("_n"), F.lit(True)).otherwise(
            F.when(F.col("_first_at") <= F.col("_last_at"), after & before).otherwise(after | before)
        )
        marked = rows.join(ends, label).select(key, label, features, asks.alias("_asks"))
        near = nearest_in_class(marked, key, label, features, k, asked="_asks")
    elif neighbours == "pruned":
        near = nearest_by_pivots(rows, key, label, features, k)
    else:
        raise ValueError(f"unknown kind of neighbours: {neighbours}")
    near = near.select(key, label, F.col("neighbour"), F.col("rank").cast("bigint").alias("_rank"))
    # both ends of a line come from one join: the rows are shuffled once for it
    lines = slots.join(numbered, [label, "_at"]).join(near, [label, key, "_rank"])
    each = F.array(
        F.struct(F.col(key).alias("_end"), F.lit(False).alias("_far")),
        F.struct(F.col("neighbour").alias("_end"), F.lit(True).alias("_far")),
    )
    there = rows.select(F.col(key).alias("_end"), F.col(features).cast("array<double>").alias("_x"))
    return (
        lines.select(label, "slot", "_u", F.inline(each))
        .join(there, "_end")
        .groupBy(label, "slot", "_u")
        .agg(
            F.first(F.when(~F.col("_far"), F.col("_x")), ignorenulls=True).alias("_a"),
            F.first(F.when(F.col("_far"), F.col("_x")), ignorenulls=True).alias("_b"),
        )
        .select(label, "slot", F.zip_with("_a", "_b", lambda x, y: x + F.col("_u") * (y - x)).alias(features))
    )


def smote(
    df: DataFrame,
    key: str,
    label: str,
    features: str,
    target: int = SMOTE_TARGET,
    when_empty: str = "auto",
    seed: int = 0,
    neighbours: str = "exact",
) -> DataFrame:
    """The rows (label, features, synthetic) with small classes filled up.

    ``neighbours='pruned'`` gives the same rows and compares only what pivots cannot
    exclude: for large classes whose rows lie in clusters or few dimensions.
    """
    extra, k = smote_plan(known_classes(df, label), target, when_empty)
    original = df.select(
        label, F.col(features).cast("array<double>").alias(features), F.lit(False).alias("synthetic")
    )
    if not extra:
        return original
    new = synthetic_rows(df, key, label, features, extra, k, seed, neighbours)
    return original.unionByName(
        new.select(label, features, F.lit(True).alias("synthetic"))
    )

"""Ordered computations (ranks, running totals, last-N, exact samples) that
never bring a whole order, or a whole group, into one task.

A window over an order without a partition key, or over a key that holds a
third of the table, runs in one task. Here rows are range-partitioned along the
order and written; each partition is summed on its own and the running total
over the (few) partition sums is added back. Ranges are sampled from the full
order columns, of any type, so text that shares a beginning, or a first column
with few values, is spread like anything else; rows that are equal in all order
columns are spread by an arbitrary last column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.values import clean_number
from packetloom.operators.bounds import leading_bound
from packetloom.session import written

_BUCKET = "_order_bucket"
_TIE = "_order_tie"
#: rows of the last hash slice, which one task sorts
_SLICE_ROWS = 10_000
_SLICE_DIGITS = 3
#: rows per group up to which Spark limits them before a shuffle
_FEW = 1000


def default_buckets(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_order_bucket(
    df: DataFrame,
    order: Sequence[str],
    buckets: int | None = None,
    name: str = _BUCKET,
    descending: bool = False,
) -> DataFrame:
    """The rows with a bucket number that never decreases along ``order``, and a
    tie-break for rows that are equal in it. Written, so that both stay."""
    keys = [*[F.col(c).desc() if descending else F.col(c).asc() for c in order], F.col(_TIE)]
    spread = df.withColumn(_TIE, F.monotonically_increasing_id()).repartitionByRange(
        buckets or default_buckets(df), *keys
    )
    return written(spread.withColumn(name, F.spark_partition_id().cast("bigint")), "ordered")


def _same(keys: Sequence[str], others: Sequence[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(keys, others):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _running(
    cut: DataFrame, sums: Sequence[str], keys: Sequence[Column], by: Sequence[str]
) -> DataFrame:
    """Running ``_v_x`` as ``_t_x`` over bucketed rows ordered by ``by``, then
    ``keys``."""
    parts = cut.groupBy(*by, _BUCKET).agg(*[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums])
    # at most one row per bucket and key reaches a task of this window
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(c).alias(f"_k_{c}") for c in by],
        F.col(_BUCKET).alias("_k_bucket"),
        *[F.sum(f"_p_{n}").over(before).alias(f"_o_{n}") for n in sums],
    ).filter(" or ".join(f"`_o_{n}` is not null" for n in sums))
    # only the first key of a bucket can have begun in an earlier one: there
    # are no more offsets than buckets
    match = (F.col(_BUCKET) == F.col("_k_bucket")) & _same(by, [f"_k_{c}" for c in by])
    joined = cut.join(F.broadcast(offsets), match, "left")
    within = (
        Window.partitionBy(*by, _BUCKET)
        .orderBy(*keys)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return joined.withColumns(
        {
            f"_t_{n}": F.sum(f"_v_{n}").over(within) + F.coalesce(F.col(f"_o_{n}"), F.lit(0))
            for n in sums
        }
    )


def running_totals(
    df: DataFrame,
    sums: Mapping[str, Column],
    order: Sequence[str],
    by: Sequence[str] = (),
    buckets: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add running sums along ``order`` (a unique key) within ``by``.

    The rows are shuffled by range and written once.
    """
    by, order = list(by), list(order)
    valued = df.withColumns({f"_v_{n}": v for n, v in sums.items()})
    # groups first: each lies in neighbouring buckets
    if descending:
        cut = with_order_bucket(valued, [*by, *order], buckets, descending=True)
        keys = [F.col(c).desc() for c in order]
    else:
        cut = with_order_bucket(valued, [*by, *order], buckets)
        keys = [F.col(c).asc() for c in order]
    out = _running(cut, list(sums), [*keys, F.col(_TIE)], by)
    return out.select(*df.columns, *[F.col(f"_t_{n}").alias(n) for n in sums])


def with_rank(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "rank",
    buckets: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """Exact 1-based row number along ``order`` within ``by``."""
    one = F.lit(1).cast("bigint")
    return running_totals(df, {name: one}, order, by, buckets, descending)


def _leading(df: DataFrame, order: Sequence[str], n: int, descending: bool) -> DataFrame:
    """The first ``n`` rows: whole buckets, and a part of one."""
    if n < 0:
        raise ValueError("n must not be negative")
    if n == 0:
        return df.limit(0)
    # all but the rest of one cell stays where it is
    bound = leading_bound(df, order, n, descending)
    if bound is not None:
        df = df.filter(bound)
    cut = with_order_bucket(df, order, descending=descending)
    whole, left = -1, n
    for row in sorted(cut.groupBy(_BUCKET).count().collect()):  # a row per bucket
        if row["count"] > left:
            break
        whole, left = row[_BUCKET], left - row["count"]
    inside = cut.filter(F.col(_BUCKET) <= whole)
    following = cut.filter(F.col(_BUCKET) > whole)
    edge = following.filter(F.col(_BUCKET) == following.agg(F.min(_BUCKET)).scalar())
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    window = Window.partitionBy(_BUCKET).orderBy(*keys, _TIE)
    part = edge.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= left)
    return inside.unionByName(part.drop("_rn")).select(*df.columns)


def first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of an order, NULL first. The order columns are counted before
    rows are taken: write a table first whose order columns are costly."""
    return _leading(df, order, n, descending=False)


def last_n(df: DataFrame, order: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows, of the table or of every ``by`` group."""
    if n < 0:
        raise ValueError("n must not be negative")
    if not by:
        return _leading(df, order, n, descending=True)
    if n == 0:
        return df.limit(0)
    # a group's newest are newest in their slot, too: Spark drops the others before the
    # shuffle, and slots spread a group that holds much of the table
    slot = F.pmod(F.xxhash64(*order), F.lit(default_buckets(df)))
    keys = [F.col(c).desc() for c in order]
    early = Window.partitionBy(*by, slot).orderBy(*keys)
    few = df.withColumn("_early", F.row_number().over(early)).filter(F.col("_early") <= n)
    if n <= _FEW:
        # at most n rows of each slot reach the task of a group
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*keys))
        ranked = few.drop("_early").withColumn("_rank", rank)
    else:
        ranked = with_rank(few.drop("_early"), order, by, name="_rank", descending=True)
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def every_nth(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Every ``n``-th row of an order, with its row number."""
    if n < 1:
        raise ValueError("n must be positive")
    return with_rank(df, order, name="row_number").filter(F.col("row_number") % n == 0)


def latest_value(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """The value of the newest row, as one row."""
    return df.agg(F.max_by(value, F.struct(*order)).alias(f"latest_{value}"))


def hash_order(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of a unique key."""
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")))


def hash_cuts(
    df: DataFrame,
    key: str,
    seed: int,
    quota: DataFrame,
    by: Sequence[str] = (),
) -> DataFrame:
    """The hash up to which each group fills its ``quota`` (columns: by, quota):
    columns by, ``cut`` and ``left``, the rows still missing at the cut itself
    (more may share it when keys repeat).

    Rows are counted by the leading digits of their hash; only the slice in
    which a group's quota runs out is counted by further digits, until it is
    small, and then sorted. Groups with a zero quota are absent.
    """
    by = list(by)
    hashed = df.select(*by, hash_order(F.col(key), seed).alias("_h"))
    names = [f"_g_{c}" for c in by]
    state = quota.filter("quota > 0").select(
        *[F.col(c).alias(n) for c, n in zip(by, names)],
        F.lit("").alias("_head"),
        F.col("quota").cast("bigint").alias("_left"),
    )
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    digits = 0
    while True:
        inside = hashed.join(state, _same(by, names) & F.col("_h").startswith(F.col("_head")))
        digits = min(32, digits + _SLICE_DIGITS)
        slices = (
            inside.groupBy(*by, "_left", F.substring("_h", 1, digits).alias("_slice"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_upto", F.sum("_n").over(group.orderBy("_slice")))
        )
        state = written(
            slices.filter("_upto >= _left and _upto - _n < _left").select(
                *[F.col(c).alias(n) for c, n in zip(by, names)],
                F.col("_slice").alias("_head"),
                (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"),
                "_n",
            ),
            "slices",
        )
        largest = state.agg(F.max("_n")).first()[0]
        if largest is None or largest <= _SLICE_ROWS or digits == 32:
            break
        state = state.drop("_n")
    inside = hashed.join(
        state.drop("_n"), _same(by, names) & F.col("_h").startswith(F.col("_head"))
    )
    counts = inside.groupBy(*by, "_left", "_h").agg(F.count(F.lit(1)).alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(group.orderBy("_h")))
    return upto.filter("_upto >= _left and _upto - _n < _left").select(
        *by, F.col("_h").alias("cut"), (F.col("_left") - F.col("_upto") + F.col("_n")).alias("left")
    )


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, the same ones on every run; of rows that share
    the last key, the first by their other columns."""
    if n < 0:
        raise ValueError("n must not be negative")
    quota = df.agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("quota"))
    row = hash_cuts(df, key, seed, quota).first()
    if row is None:
        return df.limit(0)
    below = hash_order(F.col(key), seed) < row["cut"]
    at = df.filter(hash_order(F.col(key), seed) == row["cut"])
    tied = at.withColumn("_order", F.xxhash64(*df.columns))
    return df.filter(below).unionByName(first_n(tied, ["_order"], row["left"]).drop("_order"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in a fixed pseudo-random order."""
    return df.orderBy(hash_order(F.col(key), seed))


def rolling_stats(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    size: int = 10_000,
    by: Sequence[str] = (),
    blocks: int = 10,
) -> DataFrame:
    """avg, min, max of the last ``size`` rows at every row, within ``by``.

    Ranks are cut into blocks of ``size`` rows. The last ``size`` rows are the
    end of one block and the beginning of the next, so each figure combines a
    running value from the front of a block with one from its back: the work
    per row does not depend on ``size``. Blocks go to tasks in chunks of
    ``blocks``; a chunk also gets the ``size - 1`` rows before it. No task
    holds more, however many rows a group has.
    """
    if size < 1:
        raise ValueError("size must be positive")
    by = list(by)
    chunk = size * blocks
    ranked = with_rank(df.withColumn("_v", clean_number(F.col(value))), order, by, name="_rank")
    here = F.floor((F.col("_rank") - 1) / chunk)
    upto = F.floor((F.col("_rank") + size - 2) / chunk)  # last chunk that needs the row
    spread = (
        ranked.withColumn("_home", here)
        .withColumn("_chunk", F.explode(F.sequence(here, upto)))
        .withColumn("_block", F.floor((F.col("_rank") - 1) / size))
    )
    block = Window.partitionBy(*by, "_chunk", "_block")
    front = block.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = block.orderBy(F.col("_rank").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    row = Window.partitionBy(*by, "_chunk").orderBy("_rank")
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    halves = spread.select(
        "*",
        *[f("_v").over(front).alias(f"_f_{n}") for n, f in kinds.items()],
        *[f("_v").over(back).alias(f"_b_{n}") for n, f in kinds.items()],
    )
    # the back part belongs to the window's first row, one block earlier
    # unless the window is exactly this block
    whole = F.col("_rank") % size == 0
    pairs = halves.select(
        *df.columns,
        "_rank",
        "_home",
        "_chunk",
        *[f"_f_{n}" for n in kinds],
        *[
            F.when(~whole, F.lag(f"_b_{n}", size - 1).over(row)).alias(f"_b_{n}")
            for n in kinds
        ],
    )
    total = F.col("_f_sum") + F.coalesce(F.col("_b_sum"), F.lit(0.0))
    return pairs.filter(F.col("_home") == F.col("_chunk")).select(
        *df.columns,
        (total / F.least(F.col("_rank"), F.lit(size))).alias("rolling_avg"),
        F.least("_f_min", "_b_min").alias("rolling_min"),
        F.greatest("_f_max", "_b_max").alias("rolling_max"),
    )

"""Exact nearest neighbours within classes, pruned by pivots.

Every class gets pivots, rows picked by a hash; a row belongs to the cell of its
nearest pivot. The k nearest rows of its own block give each row an upper bound. By
the triangle inequality a cell can hold a nearer row only if its pivot is no
farther than the bound plus the cell's radius, and in it only rows whose distance to
the pivot differs from the row's own by the bound at most. A row visits the
cells it cannot exclude and no others, so the result is exact, and rows that lie
in clusters are compared with few. Cells, and the visitors of a cell, are cut into blocks,
so a class or cluster that holds most rows is spread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.session import written

#: rows that a pivot stands for, and the most pivots of a class
CELL_ROWS = 250
MOST_PIVOTS = 1000
#: a distance by its bound is widened by this share: rounding must not exclude a row
_SLACK = 1e-9


def squared_distances(queries: np.ndarray, others: np.ndarray):
    """(first query row, distances to all others), some query rows at a time."""
    rows = max(1, 4_000_000 // max(1, others.size))
    for start in range(0, len(queries), rows):
        part = queries[start : start + rows]
        yield start, ((part[:, None, :] - others[None, :, :]) ** 2).sum(axis=2)


def finite_rows(frame: pd.DataFrame) -> np.ndarray:
    """The features ``_x`` as rows of doubles."""
    x = np.stack(frame["_x"].to_numpy()).astype(float, copy=False) if len(frame) else np.zeros((0, 0))
    if not np.isfinite(x).all():
        raise ValueError("features must be finite to have neighbours")
    return x


#: query rows and others whose distances are estimated at once; pairs that are then
#: measured at once, and that a row may hold before only its nearest are kept
_ESTIMATED, _MEASURED, _HELD = (256, 4096), 20_000, 400_000


def _measured(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (a[i], b[j])."""
    parts = [
        ((a[i[at : at + _MEASURED]] - b[j[at : at + _MEASURED]]) ** 2).sum(axis=1)
        for at in range(0, len(i), _MEASURED)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


def _first_of_each(i: np.ndarray, gap: np.ndarray, j: np.ndarray, most: int):
    """The pairs ordered by row, distance and position: the ``most`` first of a row."""
    order = np.lexsort((j, gap, i))
    i, gap, j = i[order], gap[order], j[order]
    begins = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
    place = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i))))
    keep = place < most
    return i[keep], gap[keep], j[keep], place[keep]


def _halves(x: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Factors whose products are lower bounds of squared distances: lengths count less
    by more than the products can be rounded."""
    x = x.astype(kind)
    share = 1 - 8 * (x.shape[1] + 8) * np.finfo(kind).eps
    length = ((x * x).sum(axis=1) * kind(share))[:, None]
    one = np.ones_like(length)
    return np.hstack([-2 * x, length, one]), np.hstack([x, one, length])


def nearest_rows(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and squared distances of the ``most`` nearest rows of ``b`` for each row
    of ``a``, ties to the first; -1 where there are fewer.

    Matrix products give a lower bound of every distance; what it leaves within the
    bound of a row is measured, so distances and order are those of all pairs.
    """
    at, far = np.full((len(a), most), -1), np.full((len(a), most), np.inf)
    if not len(a) or not len(b):
        return at, far
    scale = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    usual = 1e-100 < scale < 1e100  # else products may overflow: every pair is measured
    unit = scale if usual else 1.0
    middle = (b / unit).mean(axis=0) if usual else 0.0
    x, y = (a / unit - middle, b / unit - middle) if usual else (np.zeros((len(a), 1)), np.zeros((len(b), 1)))
    left, right = _halves(x, np.float32)[0], _halves(y, np.float32)[1]
    fine: list[np.ndarray] = []
    # what shifting and scaling can round away
    slack = 1e-18 * float((x * x).sum(axis=1).max() + (y * y).sum(axis=1).max())
    rows, columns = _ESTIMATED
    for start in range(0, len(a), rows):
        part = slice(start, min(start + rows, len(a)))
        own, upto = a[part], part.stop - start
        limit = np.full(upto, np.inf)
        held = (np.zeros(0, int), np.zeros(0), np.zeros(0, int))

        def bounded(found, limit=limit):
            i, gap, j, place = _first_of_each(*found, most)
            last = place == most - 1
            if usual:
                limit[i[last]] = gap[last] / unit / unit * (1 + 1e-6) + slack
            return i, gap, j

        if usual and len(b) > most:
            # any rows give a first bound: the nearest of an even choice by their estimates
            some = np.unique(np.linspace(0, len(b) - 1, max(most, min(len(b), 2048))).astype(int))
            near = np.argpartition(left[part] @ right[some].T, min(most, len(some)) - 1, axis=1)[:, :most]
            i, j = np.repeat(np.arange(upto), near.shape[1]), some[near].ravel()
            bounded((i, _measured(own, b, i, j), j))
        for first in range(0, len(b), columns):
            there = slice(first, first + columns)
            inside = left[part] @ right[there].T <= limit.astype(np.float32)[:, None] * np.float32(1 + 1e-6)
            if usual and np.count_nonzero(inside) > max(64 * most * upto, inside.size // 64):
                # many are alike up to the rounding of the short products
                fine = fine or [_halves(x, np.float64)[0], _halves(y, np.float64)[1]]
                inside &= fine[0][part] @ fine[1][there].T <= limit[:, None]
            i, j = np.divmod(np.flatnonzero(inside), inside.shape[1])
            # of a crowd of pairs, some at a time
            for at_ in range(0, len(i), _HELD):
                i_, j_ = i[at_ : at_ + _HELD], j[at_ : at_ + _HELD] + first
                held = tuple(np.concatenate(z) for z in zip(held, (i_, _measured(own, b, i_, j_), j_)))
                if len(held[0]) > _HELD:
                    held = bounded(held)
        i, gap, j, place = _first_of_each(*held, most)
        at[start + i, place], far[start + i, place] = j, gap
    return at, far


def _alike(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of every kind of equal rows, and the kind of each row."""
    x = np.ascontiguousarray(x + 0.0)  # no -0.0
    if not x.shape[1]:
        return np.zeros(min(1, len(x)), int), np.zeros(len(x), int)
    _, first, kind = np.unique(x.view(f"V{x.shape[1] * x.itemsize}").ravel(), return_index=True, return_inverse=True)
    return first, kind.ravel()


def nearest_of_tiles(own, a, ids, b, k):
    """Up to ``k`` nearest of ``ids`` (ascending) for each of ``own``, rows of the same key
    left out: positions, neighbours, distances, in order.

    Equal vectors are searched for once, and no more of them than can be among the
    ``k`` first are looked at, so a crowd of copies costs no more than other rows.
    """
    ids, own = pd.Series(ids), np.asarray(own)
    if not len(own) or not len(ids):
        return np.zeros(0, int), ids.to_numpy()[:0], np.zeros(0)
    most = k + (int(ids.value_counts().max()) if ids.duplicated().any() else 1)
    _, kind = _alike(b)
    order = np.argsort(kind, kind="stable")
    kept = np.sort(order[_first_of_each(kind[order], np.zeros(len(order)), order, len(order))[3] < most])
    first, kind = _alike(a)
    at, far = nearest_rows(a[first], b[kept], most)
    at, far = at[kind], far[kind]
    near = ids.to_numpy()[kept][at]
    good = (at >= 0) & (near != own[:, None]) & np.isfinite(far)
    good &= np.cumsum(good, axis=1) <= k
    return np.nonzero(good)[0], near[good], far[good]


def _nearest(own, a, ids, b, k, excluded=None):
    """Up to ``k`` nearest of ``ids`` (ascending) for each of ``own``: positions,
    neighbours, distances. ``excluded(start, rows)`` marks pairs that need no look."""
    found_at, found_id, found_gap = [], [], []
    for start, gap in squared_distances(a, b):
        gap[own[start : start + len(gap), None] == ids[None, :]] = np.inf
        if excluded is not None:
            gap[excluded(start, len(gap))] = np.inf
        best = np.argsort(gap, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(gap, best, axis=1)
        keep = np.isfinite(near)
        found_at.append(np.repeat(np.arange(start, start + len(gap)), keep.sum(axis=1)))
        found_id.append(ids[best][keep])
        found_gap.append(near[keep])
    if not found_at:
        return np.zeros(0, int), ids[:0], np.zeros(0)
    return np.concatenate(found_at), np.concatenate(found_id), np.concatenate(found_gap)


def _pivots(rows: DataFrame, key: str, label: str, block_rows: int, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """The pivots (label, ``_cell``, ``_x``), and ``_slots`` of every class, the parts
    in which its rows meet them."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    wanted = F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("_rows") / cell_rows)).cast("int")
    slots = F.ceil(F.col("_rows") / block_rows).cast("int")
    counts = written(counts.select(label, wanted.alias("_pivots"), slots.alias("_slots")), "classes")
    place = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    # Spark keeps only so many rows per class and task before the shuffle
    first = rows.withColumn("_cell", F.row_number().over(place)).filter(F.col("_cell") <= MOST_PIVOTS)
    pivots = first.join(counts, label).filter(F.col("_cell") <= F.col("_pivots"))
    pivots = written(pivots.select(label, (F.col("_cell") - 1).alias("_cell"), "_x"), "pivots")
    return pivots, counts.select(label, "_slots")


def _met(rows: DataFrame, pivots: DataFrame, slots: DataFrame, key: str, label: str):
    """Rows and pivots of a class, grouped to meet."""
    dealt = rows.join(slots, label).withColumn("_slot", F.pmod(F.xxhash64(key), F.col("_slots")).cast("int"))
    spread = pivots.join(slots, label).withColumn("_slot", F.explode(F.expr("sequence(0, _slots - 1)")))
    same = [label, "_slot"]
    return dealt.drop("_slots").groupBy(*same).cogroup(spread.drop("_slots").groupBy(*same))


def _distances(mine: pd.DataFrame, pivot: pd.DataFrame) -> np.ndarray:
    return np.sqrt(np.concatenate([gap for _, gap in squared_distances(finite_rows(mine), finite_rows(pivot))]))


def nearest_by_pivots(
    df: DataFrame, key: str, label: str, features: str, k: int, block_rows: int = 2_000, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """The exact ``k`` nearest other rows of the same class (squared Euclidean
    distance, ties to the smaller key): columns key, label, neighbour, distance, rank.

    Rows without a class have no neighbours; features that are not finite are an
    error. ``df`` should have each key once. Pairs that are looked at are counted by
    ``neighbour_pairs``.
    """
    found, _, _ = _search(df, key, label, features, k, block_rows, cell_rows)
    window = Window.partitionBy(label, key).orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def neighbour_pairs(
    df: DataFrame, key: str, label: str, features: str, k: int, block_rows: int = 2_000, cell_rows: int = CELL_ROWS
) -> tuple[int, int]:
    """Distances that the pruned search takes, those to pivots included, and those of
    all pairs of rows of a class."""
    _, work, rows = _search(df, key, label, features, k, block_rows, cell_rows)
    every = rows.groupBy(label).count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    return work.agg(F.sum("n")).first()[0] or 0, every or 0


def _search(df, key, label, features, k, block_rows, cell_rows):
    rows = df.filter(F.col(label).isNotNull()).select(
        key, label, F.col(features).cast("array<double>").alias("_x")
    )
    pivots, slots = _pivots(rows, key, label, block_rows, cell_rows)

    def assign(mine: pd.DataFrame, pivot: pd.DataFrame) -> pd.DataFrame:
        out = mine[[key, label, "_x"]].copy()
        if not len(out):
            return out.assign(_cell=[], _away=[])
        pivot = pivot.sort_values("_cell")
        far = _distances(mine, pivot)
        out["_cell"] = far.argmin(axis=1).astype(np.int32)
        out["_away"] = far.min(axis=1)
        return out

    dealt = T.StructType([rows.schema[c] for c in (key, label, "_x")]).add("_cell", T.IntegerType()).add("_away", T.DoubleType())
    cells = written(_met(rows, pivots, slots, key, label).applyInPandas(assign, dealt), "cells")
    sizes = cells.groupBy(label, "_cell").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("_away").alias("_radius"),
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"),
    )
    sizes = written(sizes, "cell-sizes")
    block = F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int").alias("_block")
    placed = cells.join(sizes.select(label, "_cell", "_blocks"), [label, "_cell"]).select(
        key, label, "_x", "_cell", "_away", block
    )
    placed = written(placed, "placed")

    schema = T.StructType(
        [
            T.StructField(key, rows.schema[key].dataType),
            T.StructField(label, rows.schema[label].dataType),
            T.StructField("neighbour", rows.schema[key].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    names = [key, label, "neighbour", "distance"]

    def table(own, group, at, near, gap):
        return pd.DataFrame({key: own[at], label: group, "neighbour": near, "distance": gap})[names]

    def inside(mine: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values(key, kind="stable")
        own, x = mine[key].to_numpy(), finite_rows(mine)
        return table(own, mine[label].iloc[0], *_nearest(own, x, own, x, k))

    first = placed.select(key, label, "_x", "_cell", "_block").groupBy(label, "_cell", "_block")
    first = written(first.applyInPandas(inside, schema), "first")
    bounds = first.groupBy(label, key).agg(
        F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("distance"))).alias("_bound")
    )
    bounded = placed.join(bounds, [label, key], "left").withColumn("_bound", F.coalesce("_bound", F.lit(float("inf"))))
    bounded = bounded.select(key, label, "_x", "_bound", F.col("_cell").alias("_own"), F.col("_block").alias("_mine"))
    circles = pivots.join(sizes.select(label, "_cell", "_radius"), [label, "_cell"])

    def reach(mine: pd.DataFrame, pivot: pd.DataFrame) -> pd.DataFrame:
        """The cells that a row cannot exclude."""
        if not len(mine):
            return mine.drop(columns="_slot").assign(_cell=[], _away=[])
        pivot = pivot.sort_values("_cell")
        far = _distances(mine, pivot)
        near = far * (1 - _SLACK) - pivot["_radius"].to_numpy()
        at, cell = np.nonzero(near <= mine["_bound"].to_numpy()[:, None] * (1 + _SLACK))
        out = mine.drop(columns="_slot").iloc[at].copy()
        out["_cell"] = pivot["_cell"].to_numpy()[cell].astype(np.int32)
        out["_away"] = far[at, cell]
        return out

    sent = T.StructType([bounded.schema[c] for c in bounded.columns]).add("_cell", T.IntegerType()).add("_away", T.DoubleType())
    visits = _met(bounded, circles, slots, key, label).applyInPandas(reach, sent)
    visits = visits.join(sizes.select(label, "_cell", "_blocks"), [label, "_cell"])
    visits = visits.withColumn("_block", F.explode(F.expr("sequence(0, _blocks - 1)")))
    # its own block is done
    visits = visits.filter("_cell <> _own or _block <> _mine").select(
        key, label, "_cell", "_block", "_x", "_bound", "_away"
    )
    visits = written(visits, "visits")
    target = [label, "_cell", "_block"]
    crowds = visits.groupBy(*target).agg(F.count(F.lit(1)).alias("_n"))
    crowds = written(crowds.withColumn("_crowds", F.ceil(F.col("_n") / block_rows).cast("int")), "crowds")
    visitors = visits.join(crowds.select(*target, "_crowds"), target).withColumn(
        "_crowd", F.pmod(F.xxhash64(key), F.col("_crowds")).cast("int")
    )
    hosts = placed.select(key, *target, "_x", "_away").join(crowds.select(*target, "_crowds"), target)
    hosts = hosts.withColumn("_crowd", F.explode(F.expr("sequence(0, _crowds - 1)")))

    def visit(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame(columns=names)
        theirs = theirs.sort_values(key, kind="stable")
        away, there = mine["_away"].to_numpy(), theirs["_away"].to_numpy()
        limit = mine["_bound"].to_numpy()

        def excluded(start, n):
            gap = np.abs(away[start : start + n, None] - there[None, :]) * (1 - _SLACK)
            return gap > limit[start : start + n, None] * (1 + _SLACK) + _SLACK * there[None, :]

        own, ids = mine[key].to_numpy(), theirs[key].to_numpy()
        found = _nearest(own, finite_rows(mine), ids, finite_rows(theirs), k, excluded)
        return table(own, mine[label].iloc[0], *found)

    both = [*target, "_crowd"]
    later = visitors.drop("_crowds").groupBy(*both).cogroup(hosts.drop("_crowds").groupBy(*both)).applyInPandas(visit, schema)
    work = (
        placed.groupBy(*target).count().select((F.col("count") * F.col("count")).alias("n"))
        .unionByName(
            # every row meets all pivots of its class, twice
            rows.groupBy(label).count().join(pivots.groupBy(label).agg(F.count(F.lit(1)).alias("p")), label)
            .select((2 * F.col("count") * F.col("p")).alias("n"))
        )
        .unionByName(
            crowds.join(placed.groupBy(*target).count(), target).select((F.col("_n") * F.col("count")).alias("n"))
        )
    )
    return first.unionByName(later), work, rows

"""Near-duplicate vectors by dual traversal of a cover tree.

The upper levels of the tree are tables: a cell has a centre, a measured covering
radius and a parent; cells with more than ``TILE`` points are cut again around
centres that lie in them. Pairs of cells are opened level by level from the roots
(one per label): pairs whose radii put all their points beyond the threshold are
pruned, pairs whose points are all within it are counted whole. What is left are
pairs of leaf cells; each is a task's group, compared by ``cover_tree.linked``, which
goes on in the same way down to single points. So exactly the pairs with a cosine
of the threshold or more are linked, and a task passes on counts and a spanning
forest, never the pairs.

Equal vectors are one point with a weight. A cell that centres cannot cut (points
all around, as far from each other as from the centre) is dealt in tiles by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.components import components
from packetloom.llm.cover_tree import EPS, angles, linked, unit
from packetloom.session import written

COSINE = 0.93
#: points of a cell that is not cut again, and of a tile
TILE = 4096
#: centres of a cut, picked from a sample of the cell's points; bounds are measured on all
FAN = 4
SAMPLE = 256
_LEVELS = 16
#: points of a cell that one task deals to its centres
_SLOT = 1 << 16


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths, as unit vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return unit(flat.reshape(len(column), -1))


def _runs(batches, width: int):
    """Consecutive rows with equal values in the first ``width`` columns: the values,
    and the rows of a batch; a run may come in several parts."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(width)]
        keys = list(zip(*columns))
        start = 0
        for at in range(1, len(keys) + 1):
            if at == len(keys) or keys[at] != keys[start]:
                yield keys[start], batch.slice(start, at - start)
                start = at


def _valid(vector: str) -> Column:
    """Whether a vector has a direction: no NULL or non-finite component, not zero."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


# --- upper levels -----------------------------------------------------------------


def _dealt(points: DataFrame, centres: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """The points (``cell``, ``node``, ``x``, ``m``) with the nearest centre of their cell
    (``parent``, ``k``, ``centre``, ``x``) as new ``cell``, and ``angle`` to it."""
    slots = counts.select("cell", F.ceil(F.col("count") / _SLOT).cast("int").alias("slots"))
    rows = points.join(slots, "cell").select(
        "cell", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int").alias("slot"),
        F.lit(-1).alias("k"), "node", "x", "m",
    )
    heads = centres.withColumnRenamed("parent", "cell").join(slots, "cell").select(
        "cell", F.explode(F.expr("sequence(0, slots - 1)")).alias("slot"), F.col("k").cast("int").alias("k"),
        F.col("centre").alias("node"), "x", F.lit(0).cast("long").alias("m"),
    )
    both = rows.unionByName(heads).repartition("cell", "slot")
    # centres before points
    both = both.sortWithinPartitions("cell", "slot", F.col("k") < 0, "k")

    def assign(batches):
        now, nodes, middle = None, [], None
        for (cell, slot, k), part in _runs(batches, 3):
            if (cell, slot) != now:
                now, nodes, middle = (cell, slot), [], None
            x = _matrix(part.column(4))
            if k >= 0:
                nodes += part.column(3).to_pylist()
                middle = x if middle is None else np.concatenate([middle, x])
                continue
            apart = angles(x, middle)
            best = np.argmin(apart, axis=1)
            names = pa.array([f"{cell}/{i}" for i in range(len(nodes))])
            yield pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(best)),
                    part.column(3),
                    part.column(4),
                    part.column(5),
                    pa.array(np.array(nodes, dtype=np.int64)[best]),
                    pa.array(apart[np.arange(len(best)), best]),
                ],
                ["cell", "node", "x", "m", "centre", "angle"],
            )

    return both.mapInArrow(
        assign, f"cell string, node long, x {kind}, m long, centre long, angle double"
    )


def _centres(points: DataFrame, kind: str, fan: int) -> DataFrame:
    """Up to ``fan`` centres per cell: its own centre, then always the point of the
    sample that is farthest from those before."""
    order = Window.partitionBy("cell").orderBy(F.col("node") != F.col("centre"), F.xxhash64("node"))
    sample = points.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= SAMPLE)

    def pick(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("at")
        x = _matrix(table.column("x").combine_chunks())
        picked, apart = [0], angles(x, x[:1])[:, 0]
        while len(picked) < min(fan, len(x)) and apart.max() > EPS:
            picked.append(int(np.argmax(apart)))
            apart = np.minimum(apart, angles(x, x[picked[-1:]])[:, 0])
        found = table.take(pa.array(picked))
        return pa.table(
            {
                "parent": found.column("cell"),
                "k": pa.array(range(len(picked)), pa.int32()),
                "centre": found.column("node"),
                "x": found.column("x"),
            }
        )

    return sample.select("cell", "node", "x", "at").groupBy("cell").applyInArrow(
        pick, f"parent string, k int, centre long, x {kind}"
    )


def _tree(points: DataFrame, kind: str, limit: float, tile: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """The leaf cell of every point (``cell``, ``node``, ``x``, ``m``) and all cells:
    ``cell``, ``parent``, ``centre``, ``x``, ``radius``, ``count``, ``weight``, ``leaf``."""
    leaves, cells = None, None
    first = points.groupBy("cell").agg(
        F.min(F.struct(F.xxhash64("node"), F.col("node").alias("centre"), "x")).alias("c"),
        F.count(F.lit(1)).alias("count"),
    )
    first = written(first, "roots")
    centres = first.select(F.col("cell").alias("parent"), F.lit(0).alias("k"), "c.centre", "c.x")
    counts, left = first.select("cell", "count"), points
    for level in range(_LEVELS):
        dealt = written(_dealt(left, centres, counts, kind), "level")
        measured = dealt.groupBy("cell", "centre").agg(
            F.max("angle").alias("radius"), F.count(F.lit(1)).alias("count"), F.sum("m").alias("weight")
        )
        # a cell whose points are all within the limit of each other needs no cut
        small = (F.col("count") <= tile) | (2 * F.col("radius") <= limit - EPS) | F.lit(level == _LEVELS - 1)
        named = centres.select("centre", "parent", "x")
        made = measured.withColumn("parent", F.regexp_extract("cell", "^(.*)/[^/]*$", 1))
        made = written(made.join(named, ["parent", "centre"]).withColumn("leaf", small), "cells")
        cells = made if cells is None else cells.unionByName(made)
        ends = dealt.join(made.filter("leaf").select("cell"), "cell", "left_semi")
        ends = ends.select("cell", "node", "x", "m")
        leaves = ends if leaves is None else leaves.unionByName(ends)
        large = made.filter("not leaf").select("cell", "count")
        if large.isEmpty():
            break
        left = dealt.join(large.select("cell"), "cell", "left_semi")
        centres = written(_centres(left, kind, fan), "centres")
        left, counts = left.select("cell", "node", "x", "m"), large
    return leaves, cells


# --- dual traversal -----------------------------------------------------------------


def _cell_pairs(cells: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of cells (``a``, ``b``, a = b for a cell with itself): those taken whole, and
    those of leaves to be compared."""
    x = F.transform("x", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, v: s + v * v))
    # scaled first, so that no square leaves the range of doubles
    top = F.array_max(F.transform(x, F.abs))
    node = cells.withColumn("u", F.transform(x, lambda v: v / top)).withColumn("norm", norm)
    node = node.select("cell", "parent", "radius", "leaf", F.transform("u", lambda v: v / F.col("norm")).alias("u"))
    node = written(node, "nodes")
    # a leaf stays while its partner is opened
    down = node.select("parent", "cell", "radius", "leaf", "u").unionByName(
        node.filter("leaf").select(F.col("cell").alias("parent"), "cell", "radius", "leaf", "u")
    )

    def side(name):
        return down.select(*[F.col(c).alias(f"{name}_{c}") for c in down.columns])

    roots = node.join(node.select(F.col("cell").alias("parent")), "parent", "left_anti").select("parent").distinct()
    pairs = roots.select(F.col("parent").alias("a"), F.col("parent").alias("b"))
    whole, leaves = [], []
    while True:
        opened = pairs.join(side("a"), F.col("a") == F.col("a_parent")).join(side("b"), F.col("b") == F.col("b_parent"))
        opened = opened.filter((F.col("a") != F.col("b")) | (F.col("a_cell") <= F.col("b_cell")))
        same = F.col("a_cell") == F.col("b_cell")
        dot = F.aggregate(F.zip_with("a_u", "b_u", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        apart = F.when(same, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
        reach = F.col("a_radius") + F.col("b_radius")
        opened = opened.withColumn("apart", apart).withColumn("reach", reach)
        opened = opened.filter(F.col("apart") - F.col("reach") <= limit + EPS)
        opened = written(
            opened.select(
                F.col("a_cell").alias("a"), F.col("b_cell").alias("b"),
                (F.col("apart") + F.col("reach") <= limit - EPS).alias("whole"),
                (F.col("a_leaf") & F.col("b_leaf")).alias("leaves"),
            ),
            "cell-pairs",
        )
        whole.append(opened.filter("whole").select("a", "b"))
        leaves.append(opened.filter("leaves and not whole").select("a", "b"))
        pairs = opened.filter("not leaves and not whole").select("a", "b")
        if pairs.isEmpty():
            break
    out = []
    for found in (whole, leaves):
        table = found[0]
        for more in found[1:]:
            table = table.unionByName(more)
        out.append(table)
    return out[0], out[1]


def _compared(points: DataFrame, cells: DataFrame, pairs: DataFrame, least: float, tile: int) -> DataFrame:
    """``node``, ``other``, ``n``: a link (``n`` NULL) or an addition to the partners of
    ``node`` (``other`` NULL), from the pairs of leaf cells."""
    slots = written(cells.filter("leaf").select("cell", F.ceil(F.col("count") / tile).cast("int").alias("slots")), "slots")
    listed = pairs
    for name in ("a", "b"):
        listed = listed.join(slots.select(F.col("cell").alias(name), F.col("slots").alias("slots_")), name)
        listed = listed.withColumn(f"s{name}", F.explode(F.expr("sequence(0, slots_ - 1)"))).drop("slots_")
    listed = listed.filter("a <> b or sa <= sb").withColumn("pair", F.concat_ws("|", "a", "sa", "b", "sb"))
    ends = listed.select("pair", F.explode(F.array_distinct(F.array(
        F.struct(F.col("a").alias("cell"), F.col("sa").alias("slot")),
        F.struct(F.col("b").alias("cell"), F.col("sb").alias("slot")),
    ))).alias("e")).select("pair", "e.*")
    placed = points.join(slots, "cell").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int"))
    sent = placed.join(ends, ["cell", "slot"]).select("pair", "cell", "slot", "node", "x", "m")
    sent = sent.repartition("pair").sortWithinPartitions("pair", "cell", "slot")

    def finished(sides):
        if not sides:
            return
        tiles = [pa.Table.from_batches(parts) for parts in sides.values()]
        x = [_matrix(t.column("x").combine_chunks()) for t in tiles]
        m = [t.column("m").to_numpy() for t in tiles]
        nodes = [t.column("node").to_numpy() for t in tiles]
        if len(tiles) == 1:
            add, _, p, q = linked(x[0], None, m[0], None, least)
        else:
            one, two, p, q = linked(x[0], x[1], m[0], m[1], least)
            add = np.concatenate([one, two])
        every = np.concatenate(nodes)
        some = np.flatnonzero(add)
        none = np.full(len(some), -1)
        node = np.concatenate([every[some], every[p]])
        other = np.concatenate([none, every[q]])
        n = np.concatenate([add[some], np.full(len(p), -1)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(node), pa.array(other, mask=other < 0), pa.array(n, mask=n < 0)], ["node", "other", "n"]
        )

    def compare(batches):
        now, sides = None, {}
        for (pair, cell, slot), part in _runs(batches, 3):
            if pair != now:
                yield from finished(sides)
                now, sides = pair, {}
            sides.setdefault((cell, slot), []).append(part)
        yield from finished(sides)

    return sent.mapInArrow(compare, "node long, other long, n long")


def near_vectors(
    vectors: DataFrame, least: float = COSINE, tile: int = TILE, fan: int = FAN
) -> DataFrame:
    """``vec_id``, ``n_links`` (other rows with a cosine of ``least`` or more and the same
    label), ``component_id`` (smallest ``vec_id`` reachable by links) and ``kept`` for every
    row of ``vectors`` (``vec_id``, ``embedding``, ``label``; other columns are ignored).

    Rows link only with rows of the same label that is not NULL, and of as many
    components. A vector that is NULL, empty, zero or holds a NULL or non-finite
    component links with nothing. Equal rows link with each other and are counted
    each. A NULL ``vec_id`` is the smallest of a component only where it has no other;
    ``kept`` compares null-safe. An empty table gives no rows.
    """
    limit = float(np.arccos(least))
    rows = vectors.select("vec_id", "label", "embedding").withColumn("n", F.monotonically_increasing_id())
    rows = written(rows, "vectors")
    kind = rows.schema["embedding"].dataType.simpleString()
    fit = F.col("label").isNotNull() & _valid("embedding")
    cell = F.concat_ws("|", F.size("embedding"), F.hex(F.col("label").cast("string")))
    points = rows.filter(fit).groupBy("label", "embedding").agg(F.min("n").alias("node"), F.count(F.lit(1)).alias("m"))
    points = written(points.select("node", "m", "label", F.col("embedding").alias("x"), cell.alias("cell")), "points")
    named = rows.select("n", "vec_id", F.when(fit, F.col("label")).alias("label"), "embedding").join(
        points.select("node", "m", "label", F.col("x").alias("embedding")), ["label", "embedding"], "left"
    )
    named = written(named.select("n", "vec_id", "m", F.coalesce("node", "n").alias("node")), "named")

    leaves, cells = _tree(points.select("cell", "node", "x", "m"), kind, limit, tile, fan)
    whole, pairs = _cell_pairs(cells, limit)
    whole = written(whole, "whole")
    found = written(_compared(leaves, cells, pairs, least, tile), "found")

    # pairs of cells that were taken whole: every point below one is linked to all of the other
    both = whole.select(F.col("a").alias("cell"), F.col("b").alias("other")).unionByName(
        whole.filter("a <> b").select(F.col("b").alias("cell"), F.col("a").alias("other"))
    )
    facts = cells.select("cell", "centre", "weight")
    sums = both.join(facts.select(F.col("cell").alias("other"), "weight"), "other").groupBy("cell").agg(
        F.sum("weight").alias("add"), F.sum((F.col("cell") == F.col("other")).cast("long")).alias("self")
    )
    prefixes = F.expr("transform(sequence(1, size(split(cell, '/'))), i -> substring_index(cell, '/', i))")
    above = cells.filter("leaf").select("cell", F.explode(prefixes).alias("upper"))
    upper = sums.join(facts, "cell").select(F.col("cell").alias("upper"), "add", "self", "centre")
    gains = written(
        above.join(upper, "upper").groupBy("cell").agg(
            F.sum("add").alias("add"), F.sum("self").alias("self"), F.collect_set("centre").alias("centres")
        ),
        "gains",
    )
    gained = leaves.select("cell", "node", "m").join(gains, "cell")
    adds = found.filter("other is null").select("node", "n").unionByName(
        gained.select("node", (F.col("add") - F.col("self") * F.col("m")).alias("n"))
    )
    degree = adds.groupBy("node").agg(F.sum("n").alias("partners"))
    middle = facts.select(F.col("cell").alias("a"), F.col("centre").alias("u"))
    other = facts.select(F.col("cell").alias("b"), F.col("centre").alias("v"))
    links = (
        found.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))
        .unionByName(gained.select(F.col("node").alias("u"), F.explode("centres").alias("v")))
        .unionByName(whole.join(middle, "a").join(other, "b").select("u", "v"))
    )
    roots = written(components(links), "classes").toDF("node", "root")
    full = (
        named.join(degree, "node", "left")
        .join(roots, "node", "left")
        .select(
            "vec_id",
            (F.coalesce("partners", F.lit(0)) + F.coalesce("m", F.lit(1)) - 1).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        )
    )
    least_id = full.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return full.join(least_id, "root").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )

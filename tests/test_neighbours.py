"""Pruned neighbours against all pairs."""

import numpy as np
import pytest

from packetloom.operators import neighbours as N
from packetloom.operators.balance import nearest_in_class


def clustered(seed, n, dim=8, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 20
    x = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim))
    x[: n // 20] = x[0]  # many equal rows
    label = np.where(rng.random(n) < 0.7, 1, rng.integers(2, 5, n))  # one class holds most
    return x, label


def frame(spark, x, label):
    rows = [(i, int(c), x[i].tolist()) for i, c in enumerate(label)]
    rows += [(10_000, None, x[0].tolist()), (10_001, 99, x[1].tolist())]  # no class; alone in it
    return spark.createDataFrame(rows, "id long, c int, x array<double>").repartition(3)


@pytest.mark.parametrize("block_rows, cell_rows", [(2000, 250), (60, 25), (15, 10_000)])
def test_equal_to_all_pairs(spark, block_rows, cell_rows):
    x, label = clustered(block_rows, 700)
    out = N.nearest_by_pivots(frame(spark, x, label), "id", "c", "x", 4, block_rows, cell_rows)
    got: dict = {}
    for r in out.collect():
        got[(r["id"], r["rank"])] = (r["neighbour"], r["distance"])
    want = {}
    for i in range(len(x)):
        mine = np.flatnonzero((label == label[i]) & (np.arange(len(x)) != i))
        gap = ((x[i] - x[mine]) ** 2).sum(axis=1)
        for rank, j in enumerate(np.argsort(gap, kind="stable")[:4], 1):
            want[(i, rank)] = (mine[j], gap[j])
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] for k in want)
    assert all(abs(got[k][1] - want[k][1]) <= 1e-9 * max(1, want[k][1]) for k in want)


def test_most_pairs_are_never_looked_at(spark):
    x, label = clustered(1, 6000)
    looked, every = N.neighbour_pairs(frame(spark, x, label), "id", "c", "x", 5, 500, 60)
    assert looked < every / 5


def test_empty_table_and_broken_features(spark):
    empty = spark.createDataFrame([], "id long, c int, x array<double>")
    assert N.nearest_by_pivots(empty, "id", "c", "x", 3).collect() == []
    broken = spark.createDataFrame([(1, 1, [float("nan")]), (2, 1, [0.0])], "id long, c int, x array<double>")
    with pytest.raises(Exception, match="finite"):
        N.nearest_by_pivots(broken, "id", "c", "x", 3).collect()


def rows_made(plan, kind):
    """Rows that the plan's nodes of a kind have passed on in the run that is over."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return rows_made(plan.executedPlan(), kind)
    if name.endswith("QueryStageExec"):
        return rows_made(plan.plan(), kind)
    own = plan.metrics().apply("numOutputRows").value() if name == kind else 0
    below = plan.children()
    return own + sum(rows_made(below.apply(i), kind) for i in range(below.size()))


def test_copies_of_a_row_do_not_follow_the_blocks(spark):
    x, label = clustered(3, 1200)
    out = nearest_in_class(frame(spark, x, label), "id", "c", "x", 4, block_rows=5)
    got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in out.collect()}
    for i in range(len(x)):
        mine = np.flatnonzero((label == label[i]) & (np.arange(len(x)) != i))
        gap = ((x[mine] - x[i]) ** 2).sum(axis=1)
        for rank, j in enumerate(np.argsort(gap, kind="stable")[:4], 1):
            assert got[(i, rank)] == (mine[j], gap[j])
    assert len(got) == 4 * len(x)
    # with 5 rows a block the class of 840 rows has 168 blocks
    assert 0 < rows_made(out._jdf.queryExecution().executedPlan(), "GenerateExec") < 15 * len(x)


def test_only_the_neighbours_that_are_asked_for(spark):
    x, label = clustered(4, 500)
    rows = frame(spark, x, label)
    every = nearest_in_class(rows, "id", "c", "x", 3, block_rows=30).filter("id % 7 = 2 or id > 10000")
    some = nearest_in_class(rows.selectExpr("*", "id % 7 = 2 as a"), "id", "c", "x", 3, block_rows=30, asked="a")
    want = sorted(every.filter("id % 7 = 2").collect())
    assert want and sorted(some.collect()) == want


@pytest.mark.parametrize("shape", ["apart", "grid", "copies", "crowds", "far off", "tiny", "huge"])
@pytest.mark.parametrize("width", [1, 3, 64])
def test_nearest_rows_are_those_of_all_pairs(shape, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(700, width))
    if shape == "grid":
        x = rng.integers(0, 3, (700, width)).astype(float)
    elif shape == "copies":
        x = x[rng.integers(0, 4, 700)]
    elif shape == "crowds":
        x = x[rng.integers(0, 4, 700)] * 1e5 + x * 1e-4
    elif shape != "apart":
        x = x + 1e7 if shape == "far off" else x * (1e-170 if shape == "tiny" else 1e140)
    key = np.sort(rng.integers(0, 650, 700))  # some twice
    at, near, gap = N.nearest_of_tiles(key[:300], x[:300], key, x, 4)
    place = 0
    for i in range(300):
        far = ((x[i] - x) ** 2).sum(axis=1)
        far[key == key[i]] = np.inf
        for j in np.argsort(far, kind="stable")[:4]:
            assert (at[place], near[place], gap[place]) == (i, key[j], far[j])
            place += 1
    assert place == len(at)

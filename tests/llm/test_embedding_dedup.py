"""Near vectors against all pairs; the tree and its bounds on their own."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from packetloom.llm import cover_tree as C
from packetloom.llm.embedding_dedup import near_vectors

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.StringType()),
        T.StructField("node", T.StringType()),
    ]
)


def fits(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(rows, least=0.93):
    n = len(rows)
    links = [set() for _ in rows]
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            (_, a, k), (_, b, m) = rows[i], rows[j]
            if k is None or k != m or not (fits(a) and fits(b)) or len(a) != len(b):
                continue
            a, b = np.array(a, dtype=float), np.array(b, dtype=float)
            if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                links[i].add(j)
                links[j].add(i)
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    out = []
    for i, (vec, _, _) in enumerate(rows):
        ids = [r[0] for r, c in zip(rows, root) if c == root[i] and r[0] is not None]
        least_id = min(ids, default=None)
        out.append((vec, len(links[i]), least_id, vec == least_id))
    return sorted(out, key=repr)


def clustered(seed, n, dim=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(8, dim))
    spread = rng.choice([0.02, 0.1, 0.4, 1.0], size=n)
    x = middle[rng.integers(0, 8, n)] + spread[:, None] * rng.normal(size=(n, dim))
    return (x * rng.uniform(0.1, 9, size=(n, 1))).astype(np.float32)


@pytest.mark.parametrize("tile, fan", [(4096, 4), (20, 3), (5, 2)])
def test_against_all_pairs(spark, tile, fan):
    x = clustered(tile, 260)
    rows = [(i, x[i].tolist(), "a" if i % 3 else "b/0") for i in range(len(x))]
    rows += [(900 + i, x[3].tolist(), "a") for i in range(7)] + [(5, x[5].tolist(), "a")]
    df = spark.createDataFrame([(*r, "z") for r in rows], VECTORS).repartition(3)
    got = sorted((tuple(r) for r in near_vectors(df, tile=tile, fan=fan).collect()), key=repr)
    assert got == plain(rows)
    assert any(not r[3] for r in got) and any(r[1] == 0 for r in got)


def test_odd_rows(spark):
    one = [1.0, 0.0, 0.0]
    rows = [
        (None, one, "a"), (3, one, "a"), (3, one, "a"), (1, [2.0, 0.1, 0.0], "a"),
        (4, one, None), (5, one, None), (6, None, "a"), (7, [], "a"), (8, [0.0] * 3, "a"),
        (9, [1.0, None, 0.0], "a"), (10, [1.0, float("nan"), 0.0], "a"), (11, [float("inf"), 0.0, 0.0], "a"),
        (12, [1.0, 0.0], "a"), (13, [1e-30, 0.0, 0.0], "a"), (14, [3e38, 0.0, -0.0], "a"),
        (None, [0.0, 1.0, 0.0], "b"), (None, [0.0, 1.0, 0.0], "b"), (None, None, None), (15, one, "b"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], VECTORS)
    got = sorted((tuple(r) for r in near_vectors(df).collect()), key=repr)
    assert got == plain(rows)
    assert near_vectors(df.limit(0)).collect() == []


def test_bounds_prune_and_take_whole():
    x = C.unit(clustered(1, 3000, 4))
    tree = C.CoverTree(x)
    for i in range(len(tree.centre)):
        inside = tree.points[tree.begin[i] : tree.end[i]]
        assert C.angles(inside, tree.middle[i : i + 1]).max() <= tree.radius[i] + 1e-9
        for k in range(tree.first[i], tree.last[i]):
            assert tree.radius[k] <= tree.radius[i] / 2 + 1e-12 or tree.end[k] - tree.begin[k] <= C.LEAF
    limit = math.acos(0.93)
    (wi, wj), (li, lj) = C.traverse(tree, tree, limit)
    size = tree.end - tree.begin
    compared = int((size[li] * size[lj]).sum())
    assert 0 < compared < len(x) ** 2 / 8 and len(wi)
    add, _, p, q = C.linked(x, None, np.ones(len(x), dtype=np.int64), None, 0.93)
    near = x @ x.T >= 0.93
    assert (add == near.sum(axis=1) - 1).all()
    assert (C.forest(p, q, len(x)) == C.forest(*np.nonzero(near), len(x))).all()

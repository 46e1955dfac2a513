"""A cover tree over unit vectors and the dual traversal of two of them, in numpy.

Distances are angles. A node holds the points within its radius of its centre; its
children's centres lie in it, the parent's own centre first (nested levels), and
cover its points within half its radius. Points that no other point shares such a
ball with are kept together in leaves. The traversal takes pairs of nodes: a pair
whose covering radii put all its points beyond the threshold is pruned, one whose
points are all within it is taken whole, any other is opened down to the leaves.
"""

from __future__ import annotations

import numpy as np

#: nodes of so many points or fewer are not cut
LEAF = 64
#: angles are rounded; within this margin of the threshold nothing is decided by bounds
EPS = 1e-6
_CHUNK = 1 << 17


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


class CoverTree:
    """Nodes as arrays: ``centre``, ``radius``, ``begin`` and ``end`` (of ``order``),
    and the numbers of the first child and the one after the last."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.centre, self.radius, self.begin, self.end = [0], [0.0], [0], [len(points)]
        self.first, self.last = [0], [0]
        self.radius[0] = float(angles(points, points[:1]).max())
        at = 0
        while at < len(self.centre):
            if self.end[at] - self.begin[at] > LEAF and self.radius[at] > EPS:
                self._cut(at)
            at += 1
        names = ("centre", "radius", "begin", "end", "first", "last")
        for name in names:
            setattr(self, name, np.array(getattr(self, name)))
        self.points = points[self.order]
        self.middle = points[self.centre]
        self.leaf = self.first == self.last

    def _cut(self, at: int) -> None:
        begin, rest = self.begin[at], self.order[self.begin[at] : self.end[at]]
        half, centre = self.radius[at] / 2, self.centre[at]
        groups, alone = [], []
        while len(rest):
            near = angles(self.points[rest], self.points[centre : centre + 1])[:, 0]
            inside = near <= half
            inside[rest == centre] = True
            if inside.sum() > 1:
                groups.append((centre, rest[inside], float(near[inside].max())))
            else:
                alone.append(centre)
            rest = rest[~inside]
            centre = rest[0] if len(rest) else None
        for i in range(0, len(alone), LEAF):
            some = np.array(alone[i : i + LEAF])
            reach = angles(self.points[some], self.points[some[:1]]).max()
            groups.append((some[0], some, float(reach)))
        self.first[at] = len(self.centre)
        for centre, members, radius in groups:
            self.order[begin : begin + len(members)] = members
            self.centre.append(centre)
            self.radius.append(radius)
            self.begin.append(begin)
            begin += len(members)
            self.end.append(begin)
            self.first.append(0)
            self.last.append(0)
        self.last[at] = len(self.centre)


def _pairs_of(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[i] - 1 for every i, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _opened(tree: CoverTree, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of the nodes ``at``, and which of ``at`` each belongs to."""
    counts = tree.last[at] - tree.first[at]
    return np.repeat(tree.first[at], counts) + _pairs_of(counts), np.repeat(np.arange(len(at)), counts)


def traverse(a: CoverTree, b: CoverTree, limit: float):
    """Pairs of nodes as two arrays each: those with every pair of points within the
    angle ``limit``, and those of leaves to be compared point by point. With ``a is b``
    every pair of points is met once, and a node with itself for those inside it."""
    i = j = np.zeros(1, dtype=np.int64)
    whole, leaves = [], []
    while len(i):
        apart = np.empty(len(i))
        for k in range(0, len(i), _CHUNK):
            part = slice(k, k + _CHUNK)
            dots = np.einsum("ij,ij->i", a.middle[i[part]], b.middle[j[part]])
            apart[part] = np.arccos(np.clip(dots, -1.0, 1.0))
        reach = a.radius[i] + b.radius[j]
        within = apart + reach <= limit - EPS
        whole.append((i[within], j[within]))
        on = ~within & (apart - reach <= limit + EPS)
        i, j = i[on], j[on]
        done = a.leaf[i] & b.leaf[j]
        leaves.append((i[done], j[done]))
        i, j = i[~done], j[~done]
        same = (i == j) if a is b else np.zeros(len(i), dtype=bool)
        # a node with itself: its children two by two, and each with itself
        kids, owner = _opened(a, i[same])
        more = a.last[i[same]][owner] - kids
        first = np.repeat(kids, more)
        found_i, found_j = [first], [first + _pairs_of(more)]
        i, j = i[~same], j[~same]
        left = ~a.leaf[i] & (b.leaf[j] | (a.radius[i] >= b.radius[j]))
        kids, owner = _opened(a, i[left])
        found_i.append(kids)
        found_j.append(j[left][owner])
        kids, owner = _opened(b, j[~left])
        found_i.append(i[~left][owner])
        found_j.append(kids)
        i, j = np.concatenate(found_i), np.concatenate(found_j)
    return [tuple(np.concatenate(side) for side in zip(*found)) for found in (whole, leaves)]


def _similar(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    dots = x @ y.T
    hits = dots >= least
    # the order of summation decides here: once more, in one fixed order
    for p, q in zip(*np.nonzero(np.abs(dots - least) < 1e-12)):
        hits[p, q] = float(np.sum(x[p] * y[q])) >= least
    return hits


def linked(
    a: np.ndarray, b: np.ndarray | None, wa: np.ndarray, wb: np.ndarray | None, least: float
) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """For unit vectors ``a`` and ``b`` (None: ``a`` with itself) of weights ``wa`` and
    ``wb``: the summed weight of each one's partners with a cosine of ``least`` or more,
    and links (positions in ``a``, then ``b``) that join what all such pairs join."""
    one = CoverTree(a)
    two = one if b is None else CoverTree(b)
    own, other = wa[one.order], wa[one.order] if b is None else wb[two.order]
    shift = 0 if b is None else len(a)
    add_a = np.zeros(len(a), dtype=np.int64)
    add_b = add_a if b is None else np.zeros(len(b), dtype=np.int64)
    total_a, total_b = np.concatenate([[0], np.cumsum(own)]), np.concatenate([[0], np.cumsum(other)])
    (wi, wj), (li, lj) = traverse(one, two, float(np.arccos(least)))
    label = np.arange(shift + len(two.points))

    def join(p: np.ndarray, q: np.ndarray) -> None:
        nonlocal label
        p, q = label[p], label[q]
        other_root = p != q
        if other_root.any():
            label = forest(p[other_root], q[other_root], len(label))[label]

    for i, j in zip(wi.tolist(), wj.tolist()):
        x, y = slice(one.begin[i], one.end[i]), slice(two.begin[j], two.end[j])
        if b is None and i == j:
            add_a[x] += total_a[x.stop] - total_a[x.start] - own[x]
        else:
            add_a[x] += total_b[y.stop] - total_b[y.start]
            add_b[y] += total_a[x.stop] - total_a[x.start]
        rows, cols = np.arange(x.start, x.stop), np.arange(y.start, y.stop) + shift
        join(np.concatenate([rows, np.full(len(cols), rows[0])]), np.concatenate([np.full(len(rows), cols[0]), cols]))
    by = np.argsort(li, kind="stable")
    li, lj = li[by], lj[by]
    edges = [0, *(np.flatnonzero(np.diff(li)) + 1).tolist(), len(li)] if len(li) else []
    for s, e in zip(edges, edges[1:]):
        i = int(li[s])
        rows = np.arange(one.begin[i], one.end[i])
        counts = two.end[lj[s:e]] - two.begin[lj[s:e]]
        cols = np.repeat(two.begin[lj[s:e]], counts) + _pairs_of(counts)
        hits = _similar(one.points[rows], two.points[cols], least)
        if b is None:  # a point and itself, or a pair of the same leaf the second time
            hits &= (cols[None, :] > rows[:, None]) | (np.repeat(lj[s:e] != i, counts)[None, :])
        if hits.any():
            add_a[rows] += hits @ other[cols]
            np.add.at(add_b, cols, own[rows] @ hits)
            p, q = np.nonzero(hits)
            join(rows[p], cols[q] + shift)
    moved = np.flatnonzero(label != np.arange(len(label)))
    # back from the trees' order to the given one
    back = one.order if b is None else np.concatenate([one.order, two.order + shift])
    out_a = np.empty_like(add_a)
    out_a[one.order] = add_a
    out_b = None
    if b is not None:
        out_b = np.empty_like(add_b)
        out_b[two.order] = add_b
    return out_a, out_b, back[moved], back[label[moved]]


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Label (smallest member) of each of ``n`` items under the given pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        label = label[label]
        if (label == before).all():
            return label

"""Metric trees by the anchors hierarchy, and the nearest entry of a codebook for all points of a tree.

A tree is built from the middle out: about sqrt(n) anchors gather the points nearest to them, each anchor's points get a
tree of their own, and the trees are merged pairwise, closest balls first, up to one root. Every ball caches the count and
the sum of its points. The search hands each ball the list of entries that can still be nearest to one of its points; a
child inherits its parent's list and shortens it, and a ball whose list has one entry left is owned whole, without a look
at its points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Points up to which a ball is not divided.
LEAF = 24
#: Numbers in one piece of a distance table.
STEP = 1 << 20


@dataclass
class Tree:
    order: np.ndarray  # the points' numbers, so that every ball is a range of them
    points: np.ndarray  # in that order
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray  # -1 for a leaf
    right: np.ndarray
    pivot: np.ndarray
    radius2: np.ndarray  # largest squared distance to the pivot
    total: np.ndarray  # cached sums; the count is end - start


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def anchors(points: np.ndarray, count: int) -> np.ndarray:
    """Anchor of every point. A new anchor is the point farthest from its own; it takes over what is nearer to it, and
    only asks points farther than half the way between the two anchors."""
    centre = [0]
    owner = np.zeros(len(points), dtype=np.int64)
    far = squared(points, points[0])
    for k in range(1, count):
        new = int(np.argmax(far))
        if far[new] == 0:
            break
        between = squared(points[centre], points[new])
        ask = np.flatnonzero(4 * far > between[owner])
        d = squared(points[ask], points[new])
        take = d < far[ask]
        owner[ask[take]] = k
        far[ask[take]] = d[take]
        centre.append(new)
    return owner


class _Builder:
    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaf = points, leaf
        self.order: list[np.ndarray] = []
        self.at = 0
        self.nodes: list[tuple] = []  # left, right, members, pivot, radius2, total

    def node(self, members: np.ndarray, left: int = -1, right: int = -1) -> int:
        own = self.points[members]
        total = own.sum(axis=0)
        pivot = total // len(members)
        self.nodes.append((left, right, members, pivot, int(squared(own, pivot).max()), total))
        return len(self.nodes) - 1

    def build(self, members: np.ndarray) -> int:
        if len(members) <= self.leaf:
            return self.node(members)
        owner = anchors(self.points[members], int(np.ceil(np.sqrt(len(members)))))
        groups = [members[owner == k] for k in range(owner.max() + 1)]
        if len(groups) == 1:
            return self.node(members)  # all points are equal
        return self.merge([self.build(g) for g in groups])

    def merge(self, roots: list[int]) -> int:
        """One tree over all: the two balls that fit into the smallest common ball are merged first."""
        alive = list(roots)
        pivots = np.array([self.nodes[r][3] for r in alive])
        radii = np.sqrt(np.array([self.nodes[r][4] for r in alive], dtype=np.float64))
        size = np.sqrt(squared(pivots[:, None], pivots[None]).astype(np.float64)) + radii[:, None] + radii[None]
        np.fill_diagonal(size, np.inf)
        for _ in range(len(alive) - 1):
            i, j = divmod(int(np.argmin(size)), len(alive))
            i, j = min(i, j), max(i, j)
            a, b = alive[i], alive[j]
            alive[i] = self.node(np.concatenate([self.nodes[a][2], self.nodes[b][2]]), a, b)
            pivots[i], radii[i] = self.nodes[alive[i]][3], np.sqrt(self.nodes[alive[i]][4])
            size[j], size[:, j] = np.inf, np.inf
            radii[j] = np.inf
            size[i] = np.sqrt(squared(pivots, pivots[i]).astype(np.float64)) + radii + radii[i]
            size[i, i] = np.inf
            size[:, i] = size[i]
        return alive[i]


def build_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of one or more points, whole numbers as int64 in rows."""
    made = _Builder(points, leaf)
    root = made.build(np.arange(len(points)))
    order = made.nodes[root][2]
    n = len(made.nodes)
    start, end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    todo = [(root, 0)]
    while todo:
        k, at = todo.pop()
        left, right, members = made.nodes[k][:3]
        start[k], end[k] = at, at + len(members)
        if left >= 0:
            todo += [(left, at), (right, at + len(made.nodes[left][2]))]
    # children are made before parents: turned round, the root comes first
    flip = np.arange(n - 1, -1, -1)
    child = lambda x: np.array([n - 1 - made.nodes[k][x] if made.nodes[k][x] >= 0 else -1 for k in flip], dtype=np.int64)
    return Tree(
        order, points[order], start[flip], end[flip], child(0), child(1),
        np.array([made.nodes[k][3] for k in flip]), np.array([made.nodes[k][4] for k in flip], dtype=np.int64), np.array([made.nodes[k][5] for k in flip]),
    )


def _widths(lists: np.ndarray):
    """Rows of candidate lists in groups of similar length, each with its entries as a narrow matrix in rising order and
    a mark where a row has fewer."""
    counts = lists.sum(axis=1)
    low = 0
    while low < lists.shape[1]:
        high = max(1, low * 2)
        rows = np.flatnonzero((counts > low) & (counts <= high))
        if len(rows):
            width = min(high, lists.shape[1])
            own = np.argsort(~lists[rows], axis=1, kind="stable")[:, :width]
            yield rows, own, np.take_along_axis(lists[rows], own, axis=1)
        low = high


def _nearest(points: np.ndarray, entries: np.ndarray, own: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the listed entries and the column of the nearest, the first among equals."""
    d = np.empty(own.shape, dtype=np.int64)
    step = max(1, STEP // (own.shape[1] * points.shape[1]))
    for a in range(0, len(points), step):
        d[a : a + step] = squared(points[a : a + step, None], entries[own[a : a + step]])
    d[~real] = np.iinfo(np.int64).max
    return d, np.argmin(d, axis=1)


def search(tree: Tree, entries: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Who owns what: balls owned whole as (node, entry), and the single points of divided leaves with their entries.

    An entry leaves a ball's list when the list's entry nearest to the pivot is strictly nearer to every point of the
    ball: the plane half-way between the two then lies outside it. Ties go to the entry of the lower number; of equal
    entries only the first can own anything.
    """
    _, first = np.unique(entries, axis=0, return_index=True)
    whole = np.zeros(len(entries), dtype=bool)
    whole[first] = True
    gap2 = squared(entries[:, None], entries[None]).astype(np.float64)
    nodes, lists = np.array([0]), whole[None].copy()
    owned, loose, loose_lists = [], [], []
    while len(nodes):
        for rows, own, real in _widths(lists):
            at = nodes[rows]
            d, best = _nearest(tree.pivot[at], entries, own, real)
            line = np.arange(len(rows))
            lead = (d - d[line, best][:, None]).astype(np.float64)
            # strictly outside, with room for rounding: the lead exceeds twice the radius times the entries' distance
            out = (lead > 0) & (lead * lead > 4.000001 * tree.radius2[at][:, None] * gap2[own[line, best][:, None], own])
            r, c = np.nonzero(out & real)
            lists[rows[r], own[r, c]] = False
        single = lists.sum(axis=1) == 1
        owned += zip(nodes[single].tolist(), lists[single].argmax(axis=1).tolist(), strict=True)
        nodes, lists = nodes[~single], lists[~single]
        leaf = tree.left[nodes] < 0
        loose.append(nodes[leaf])
        loose_lists.append(lists[leaf])
        nodes, lists = nodes[~leaf], lists[~leaf]
        nodes, lists = np.concatenate([tree.left[nodes], tree.right[nodes]]), np.concatenate([lists, lists])
    loose, loose_lists = np.concatenate(loose), np.concatenate(loose_lists)
    sizes = tree.end[loose] - tree.start[loose]
    ball = np.repeat(np.arange(len(loose)), sizes)
    points = np.arange(len(ball)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + tree.start[loose][ball]
    entry = np.zeros(len(points), dtype=np.int64)
    group = np.zeros(len(loose), dtype=np.int64)
    for rows, own, real in _widths(loose_lists):
        group[:] = -1
        group[rows] = np.arange(len(rows))
        mine = np.flatnonzero(group[ball] >= 0)
        row = group[ball[mine]]
        _, best = _nearest(tree.points[points[mine]], entries, own[row], real[row])
        entry[mine] = own[row, best]
    return owned, points, entry


def sums_by_entry(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the points nearest to each entry; balls owned whole add what they have cached."""
    owned, points, entry = search(tree, entries)
    total, count = np.zeros_like(entries), np.zeros(len(entries), dtype=np.int64)
    np.add.at(total, entry, tree.points[points])
    np.add.at(count, entry, 1)
    if owned:
        node, own = np.array(owned).T
        np.add.at(total, own, tree.total[node])
        np.add.at(count, own, tree.end[node] - tree.start[node])
    return total, count


def owners(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """Nearest entry of every point, in the points' first order."""
    owned, points, entry = search(tree, entries)
    out = np.zeros(len(tree.order), dtype=np.int64)
    for node, own in owned:
        out[tree.order[tree.start[node] : tree.end[node]]] = own
    out[tree.order[points]] = entry
    return out

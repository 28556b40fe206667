"""Regression trees over arrays: what a task does with the rows it was sent.

* ``grow`` finishes a tree exactly (every midpoint between neighbouring values is a
  candidate, no depth limit) over the rows of one node, many nodes of a level at once;
* ``best_bins`` finds the splits of nodes from histograms of weights and weighted targets;
* ``boost`` grows boosted trees from histograms that a caller supplies; of two children
  only the lighter one's histogram is asked for, the other is its parent's less that;
* ``bag`` gives a row's weight in a tree from its id alone, so any task computes the same.

Sent to the executors by value, so tasks need numpy but no copy of this package.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(18)])


#: Gains that differ by a smaller share are equal.
TIE = 1e-9
#: Rows of a node that is split by blocks, rows of small nodes that are split together, cells in a block.
LARGE, PIECE, BLOCK = 4_096, 32_768, 256
#: Rows in one node that are led on together.
FOLLOW = 256


def mixed(v: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads neighbours (multiply and shift rounds)."""
    v = v.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
    return v ^ (v >> np.uint64(31))


def bag(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) weight of each row in ``tree``: a bootstrap sample without moving rows."""
    salt = mixed(np.array([seed * 1_000_003 + tree + 1]))
    u = mixed(ids.astype(np.int64).view(np.uint64) ^ salt) >> np.uint64(11)
    return np.searchsorted(_POISSON, u.astype(np.float64) / float(1 << 53), side="right").astype(np.float64)


def imputed(x: np.ndarray, medians: list) -> np.ndarray:
    """Missing values (NaN) as the median of their column, 0 where it has none."""
    if not np.isnan(x).any():
        return x
    return np.where(np.isnan(x), np.array([0.0 if m is None else m for m in medians]), x)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, max_depth: int | None = None) -> tuple[dict, np.ndarray]:
    """A least-squares tree over the rows with ``w > 0``, and the node in which each row of ``x`` ends."""
    tree = grown(x, y, w, max_depth)
    return tree, walk(tree, x)


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, max_depth: int | None = None) -> dict:
    """A least-squares tree over the rows with ``w > 0``.

    Returns the nodes (``feature`` -1 for a leaf, ``threshold``, ``left``; the right child follows
    the left one; ``value``, ``gain``). Equal gains go to the first feature, then the lowest threshold.
    A node is a leaf when its targets are equal, when no feature differs in it, or at ``max_depth``.
    A node of ``LARGE`` rows or more hands the rows of its lighter child on and goes on as the heavier one
    (``_Large``), so a tree costs about rows times the logarithm of rows, however deep it is. Smaller
    nodes are split level by level, about ``PIECE`` rows together: every feature has its own copy of
    the rows, by node and then by value.
    """
    n, d = x.shape
    rows = np.flatnonzero(w > 0)
    mean = float(np.average(y[rows], weights=w[rows]))
    y = np.where(w > 0, y - mean, 0.0)
    cells, there, right = [np.zeros(n, np.int32) for _ in range(d)], np.zeros(n, bool), np.zeros(n, bool)
    parts, size = [], 1
    large, small = [(rows, 0, 0)], []
    while large or small:
        # the nodes that wait are finished together, as many as make up a piece
        while large and sum(len(r) for r, _, _ in small) < PIECE:
            rows, node, depth = large.pop()
            some, count = None, len(rows)
            while d and count >= LARGE and depth != max_depth:
                if some is None or count < some.built // 2:
                    some = _Large(x, y, w, rows if some is None else some.left_over(), cells, there)
                cut = some.best()
                if cut is None:
                    break
                j, cell, threshold, center, gain = cut
                parts.append(tuple(map(np.array, ([node], [j], [threshold], [size], [mean + center], [gain]))))
                light, count, is_left = some.parted(j, cell)
                depth += 1
                large.append((light, size + 1 - is_left, depth))
                node, size = size + is_left, size + 2
            small.append((rows if some is None else some.left_over(), node, depth))
        size = _grow_small(x, y, w, small, max_depth, mean, right, parts, size)
        small = []
    at = np.concatenate([p[0] for p in parts])
    tree = {}
    for k, name in enumerate(("feature", "threshold", "left", "value", "gain"), 1):
        v = np.concatenate([p[k] for p in parts])
        tree[name] = np.empty_like(v)
        tree[name][at] = v
    return tree


class _Large:
    """The rows of one large node. Per feature its distinct values (cells) hold sums of weights and weighted
    targets, blocks of ``BLOCK`` cells those of their cells and the range of the running sum within them. This
    bounds the gain of every cut in a block, so only blocks that may hold the best one are looked into."""

    def __init__(self, x, y, w, rows, cells, there):
        self.w, self.y, self.cells, self.there, self.built = w, y, cells, there, len(rows)
        self.least = float(w[rows].min())
        self.noise = 1e-9 * float(np.abs(y[rows]).max()) ** 2
        self.center = float(w[rows] @ y[rows] / w[rows].sum())
        there[rows] = True
        self.by = []
        for j in range(x.shape[1]):
            o = rows[np.argsort(x[rows, j], kind="stable")]
            v = x[o, j]
            new = np.append(True, v[1:] != v[:-1])
            starts = np.flatnonzero(new)
            cells[j][o] = np.cumsum(new) - 1
            length = -(-len(starts) // BLOCK) * BLOCK
            sums = np.zeros((3, length))
            for k, u in enumerate((np.ones(len(o)), w[o], w[o] * y[o])):
                sums[k, :len(starts)] = np.add.reduceat(u, starts)
            f = {"rows": o, "ends": np.append(starts[1:], len(o)), "value": v[starts], "sums": sums,
                 "blocks": np.zeros((5, length // BLOCK))}
            self._renew(f, np.arange(length // BLOCK))
            self.by.append(f)

    def _renew(self, f: dict, b: np.ndarray) -> None:
        """Rows, weights, weighted targets and the range of the running sum of some blocks."""
        n, w, s = (v.reshape(-1, BLOCK)[b] for v in f["sums"])
        run = np.cumsum(s - self.center * w, axis=1)
        f["blocks"][:, b] = n.sum(1), w.sum(1), s.sum(1), run.min(1), run.max(1)

    def best(self) -> tuple | None:
        """Feature, cell, threshold, mean and gain of the best cut; None where no gain stands out of rounding."""
        found, best = None, -np.inf
        for j, f in enumerate(self.by):
            n, bw, bs, low, high = f["blocks"]
            all_w, all_s = bw.sum(), bs.sum()
            center = all_s / all_w
            before, sum_before = np.cumsum(bw) - bw, np.cumsum(bs) - bs
            start, off = sum_before - center * before, center - self.center
            reach = np.maximum(np.abs(start + low - max(off, 0.0) * bw), np.abs(start + high + max(-off, 0.0) * bw))
            a, z = np.maximum(before, self.least), np.minimum(before + bw, all_w - self.least)
            most = reach ** 2 * np.maximum(self._factor(a, all_w), self._factor(z, all_w))
            after = before + bw
            ok = (after > self.least / 2) & (all_w - after > self.least / 2)
            sure = float(((start + bs - center * bw)[ok] ** 2 * self._factor(after[ok], all_w)).max()) if ok.any() else 0.0
            b = np.flatnonzero((most >= max(sure, best) * (1 - 1e-6)) & (n > 0))
            if not len(b):
                continue
            n, w, s = (v.reshape(-1, BLOCK)[b] for v in f["sums"])
            lw = before[b, None] + np.cumsum(w, axis=1)
            ls = start[b, None] + np.cumsum(s - center * w, axis=1)
            rw = all_w - lw
            can = (n > 0) & (rw > self.least / 2)
            if not can.any():
                continue
            gain = np.full(lw.shape, -np.inf)
            gain[can] = ls[can] ** 2 / lw[can] + ls[can] ** 2 / rw[can]
            top = gain.max()
            if top > best + TIE * abs(best if found else 0.0):
                first = int(np.argmax(gain >= top - TIE * top))
                best, found = top, (j, int(b[first // BLOCK]) * BLOCK + first % BLOCK, center)
        if found is None or best <= self.noise * all_w:
            return None
        j, cell, center = found
        f = self.by[j]
        n = f["sums"][0]
        near = np.flatnonzero(n[cell + 1:cell + 1 + BLOCK])
        beyond = cell + 1 + int(near[0] if len(near) else np.argmax(n[cell + 1:] > 0))
        v, z = f["value"][cell], f["value"][beyond]
        half = v + (z - v) / 2
        return j, cell, float(half if half < z else v), float(center), float(best)

    @staticmethod
    def _factor(w, whole):
        return 1 / np.maximum(w, 1e-300) + 1 / np.maximum(whole - w, 1e-300)

    def parted(self, j: int, cell: int) -> tuple[np.ndarray, int, int]:
        """Takes the lighter side of a cut out: its rows, the number of the others, and whether it is the left."""
        f = self.by[j]
        n = f["sums"][0]
        held = np.flatnonzero(f["blocks"][0])
        first, last = int(held[0]) * BLOCK, min(int(held[-1] + 1) * BLOCK, len(f["ends"])) - 1
        rows, left_rows = int(f["blocks"][0].sum()), int(n[first:cell + 1].sum())
        is_left = 2 * left_rows <= rows
        begin = int(f["ends"][first - 1]) if first else 0
        middle, end = int(f["ends"][cell]), int(f["ends"][last])
        light = f["rows"][begin:middle] if is_left else f["rows"][middle:end]
        light = light[self.there[light]]
        self.there[light] = False
        for g, cells in zip(self.by, self.cells):
            k = cells[light]
            for v, u in zip(g["sums"], (1.0, self.w[light], self.w[light] * self.y[light])):
                np.subtract.at(v, k, u)
            g["sums"][:, k[g["sums"][0, k] == 0]] = 0.0
            touched = np.zeros(g["blocks"].shape[1], bool)
            touched[k // BLOCK] = True
            self._renew(g, np.flatnonzero(touched))
        return light, rows - len(light), int(is_left)

    def left_over(self) -> np.ndarray:
        rows = self.by[0]["rows"]
        return rows[self.there[rows]]


def _grow_small(x: np.ndarray, y: np.ndarray, w: np.ndarray, roots: list[tuple], max_depth: int | None, mean: float,
                right: np.ndarray, parts: list[tuple], size: int) -> int:
    """Finishes nodes ``(rows, node, depth)`` level by level, all together; the number of nodes after that."""
    d = x.shape[1]
    rows, counts = np.concatenate([r for r, _, _ in roots]), np.array([len(r) for r, _, _ in roots])
    nodes, depth = np.array([k for _, k, _ in roots]), np.array([k for _, _, k in roots])
    root = np.repeat(np.arange(len(roots)), counts)
    cols = []
    for j in range(max(d, 1)):
        o = rows[np.lexsort((x[rows, j], root))] if d else rows
        cols.append((o, x[o, j] if d else np.zeros(len(o)), w[o], y[o]))
    while len(nodes):
        starts = np.cumsum(counts) - counts
        _, _, wo, yo = cols[0]
        center = np.add.reduceat(wo * yo, starts) / np.add.reduceat(wo, starts)
        open_ = np.minimum.reduceat(yo, starts) != np.maximum.reduceat(yo, starts)
        open_ &= bool(d) & (True if max_depth is None else depth < max_depth)
        leaves = nodes[~open_]
        parts.append((leaves, np.full(len(leaves), -1), np.zeros(len(leaves)), np.full(len(leaves), -1),
                      mean + center[~open_], np.zeros(len(leaves))))
        cols, counts, nodes, center, depth = _only(open_, cols, counts), counts[open_], nodes[open_], center[open_], depth[open_]
        if not len(nodes):
            break
        best, feature, threshold, last = _best_cuts(cols, counts, center)
        split = feature >= 0
        left = np.where(split, size + 2 * (np.cumsum(split) - 1), -1)
        size += 2 * int(split.sum())
        parts.append((nodes, feature, threshold, left, mean + center, np.where(split, best, 0.0)))
        cols, counts, feature, last, left = _only(split, cols, counts), counts[split], feature[split], last[split], left[split]
        starts = np.cumsum(counts) - counts
        for j in np.unique(feature).tolist():
            mine = np.repeat(feature == j, counts)
            right[cols[j][0][mine]] = (np.arange(len(mine)) >= np.repeat(starts + last, counts))[mine]
        cols = [_parted(c, right[c[0]], starts, counts, last) for c in cols]
        depth = np.repeat(depth[split] + 1, 2)
        counts = np.column_stack([last, counts - last]).ravel()
        nodes = np.column_stack([left, left + 1]).ravel()
    return size


def _only(keep: np.ndarray, cols: list[tuple], counts: np.ndarray) -> list[tuple]:
    """The rows of some of the nodes."""
    if keep.all():
        return cols
    on = np.flatnonzero(np.repeat(keep, counts))
    return [tuple(v[on] for v in c) for c in cols]


def _best_cuts(cols: list[tuple], counts: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gain, feature (-1 for none), threshold and number of rows on the left of each node's best split."""
    size = len(counts)
    starts = np.cumsum(counts) - counts
    ends = starts + counts - 1
    node = np.repeat(np.arange(size, dtype=np.int32), counts)
    middle = center[node]
    best, feature, threshold, last = np.full(size, -np.inf), np.full(size, -1), np.zeros(size), np.zeros(size, np.int64)
    for j, (_, v, wo, yo) in enumerate(cols):
        differs = v[:-1] < v[1:]
        differs[ends[:-1]] = False
        cut = np.flatnonzero(differs)
        if not len(cut):
            continue
        so = wo * (yo - middle)  # about the node's mean, so its square sum is the gain itself
        cw, cs = np.cumsum(wo), np.cumsum(so)
        cw0, cs0 = cw[starts] - wo[starts], cs[starts] - so[starts]
        k = node[cut]
        lw, ls = cw[cut] - cw0[k], cs[cut] - cs0[k]
        rw, rs = (cw[ends] - cw0)[k] - lw, (cs[ends] - cs0)[k] - ls
        gain = ls * ls / lw + rs * rs / rw
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        own = k[first]
        top = np.maximum.reduceat(gain, first)
        than = best[own]
        better = top > than + TIE * np.abs(np.where(np.isfinite(than), than, 0.0))
        least = np.where(better, top - TIE * np.abs(top), np.inf)
        at = np.flatnonzero(gain >= np.repeat(least, np.diff(np.append(first, len(k)))))
        at = at[np.append(True, k[at[1:]] != k[at[:-1]])] if len(at) else at
        k, at = k[at], cut[at]
        best[own[better]] = top[better]
        feature[k], last[k] = j, at + 1 - starts[k]
        half = v[at] + (v[at + 1] - v[at]) / 2
        threshold[k] = np.where(half < v[at + 1], half, v[at])
    return best, feature, threshold, last


def _parted(col: tuple, right: np.ndarray, starts: np.ndarray, counts: np.ndarray, last: np.ndarray) -> tuple:
    """The rows with those of each node's left child before those of its right one, otherwise in order."""
    before = np.cumsum(right) - right
    before -= np.repeat(before[starts], counts)
    to = np.where(right, np.repeat(starts + last, counts) + before, np.arange(len(right)) - before)
    out = []
    for v in col:
        moved = np.empty_like(v)
        moved[to] = v
        out.append(moved)
    return tuple(out)


def walk(tree: dict, x: np.ndarray) -> np.ndarray:
    """The node of ``tree`` in which each row ends."""
    at = np.zeros(len(x), np.int64)
    feature, threshold, left = (np.asarray(tree[k]) for k in ("feature", "threshold", "left"))
    if min(len(x), len(feature)) >= FOLLOW and not np.isnan(x).any():
        _follow(feature, threshold, left, x, at)
    on = np.flatnonzero(feature[at] >= 0)
    while len(on):
        k = at[on]
        at[on] = left[k] + (x[on, feature[k]] > threshold[k])
        on = on[feature[at[on]] >= 0]
    return at


def _follow(feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, x: np.ndarray, at: np.ndarray) -> None:
    """Leads rows on while ``FOLLOW`` of them are in a node. They are compared with the way of one of them as a
    whole: along it the bounds of a feature only get tighter, so a search finds where a row leaves it. A row does
    not visit each node of a deep tree."""
    waiting = [np.arange(len(x))]
    while waiting:
        rows = waiting.pop()
        node, one = int(at[rows[0]]), x[rows[len(rows) // 2]].tolist()
        way, right = [], []
        while (j := feature.item(node)) >= 0:
            way.append(node)
            right.append(one[j] > threshold.item(node))
            node = left.item(node) + right[-1]
        if not way:
            continue
        way, right = np.array(way), np.array(right)
        by, limit = feature[way], threshold[way]
        leaves = np.full(len(rows), len(way))
        for j in np.unique(by).tolist():
            v = x[rows, j]
            for side in (False, True):
                k = np.flatnonzero((by == j) & (right == side))
                if len(k):
                    first = np.searchsorted(np.maximum.accumulate(limit[k]), v, side="left") if side else \
                        np.searchsorted(-np.minimum.accumulate(limit[k]), -v, side="right")
                    np.minimum(leaves, np.append(k, len(way))[first], out=leaves)
        at[rows] = np.append(left[way] + ~right, node)[leaves]
        order = np.argsort(leaves, kind="stable")
        ends = np.cumsum(np.bincount(leaves, minlength=len(way) + 1))
        for k in np.flatnonzero(np.diff(ends[:-1], prepend=0) >= FOLLOW).tolist():
            waiting.append(rows[order[ends[k - 1] if k else 0:ends[k]]])


def packed(tree: dict) -> tuple[np.ndarray, np.ndarray]:
    """The nodes level by level: their feature (-1 for a leaf), and the threshold, or the value of a leaf. The
    children of the k-th node that has any are then those at 2k + 1 and 2k + 2, and need not be kept."""
    feature, threshold, left, value = (np.asarray(tree[c]) for c in ("feature", "threshold", "left", "value"))
    levels, at = [], np.zeros(1, np.int64)
    while len(at):
        levels.append(at)
        k = left[at[feature[at] >= 0]]
        at = np.column_stack([k, k + 1]).ravel()
    order = np.concatenate(levels)
    f = feature[order].astype(np.int32)
    return f, np.where(f < 0, value[order], threshold[order])


def unpacked(feature: np.ndarray, number: np.ndarray) -> dict:
    """The tree of ``packed`` nodes."""
    return {"feature": feature, "threshold": number, "value": number,
            "left": np.where(feature >= 0, 2 * np.cumsum(feature >= 0) - 1, -1)}


def best_bins(weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For histograms ``(nodes, features, bins)`` of weights and weighted targets: the feature (-1 for
    none), the last bin of the left side, and the gain of the best split of each node."""
    lw, ls = np.cumsum(weight, axis=2), np.cumsum(total, axis=2)
    all_w, all_s = lw[:, :, -1:], ls[:, :, -1:]
    rw, rs = all_w - lw, all_s - ls
    can = (lw > 1e-9) & (rw > 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(can, ls ** 2 / lw + rs ** 2 / rw - all_s ** 2 / all_w, -np.inf)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    top = flat[np.arange(len(flat)), at]
    feature, last = np.divmod(at, weight.shape[2])
    return np.where(np.isfinite(top), feature, -1), last, top


def boost(fits: list[int], histogram: Callable, done: Callable, trees: int, depth: int) -> dict[int, dict]:
    """Boosted trees of every fit, grown side by side.

    ``histogram(wanted, current)`` gives, for (fit, node) pairs of the trees under way, the weights and
    the sums of residuals as arrays (pairs, features, bins); ``done(current)`` is told each round's trees.
    A tree is arrays in heap order (root 1, children 2k and 2k + 1): ``feature``, ``last`` bin, ``value``, ``gain``.
    """
    size = 2 << depth
    out = {f: {"feature": [], "last": [], "value": [], "gain": []} for f in fits}
    for _ in range(trees):
        now = {f: {"feature": np.full(size, -1), "last": np.zeros(size, np.int64), "value": np.zeros(size),
                   "gain": np.zeros(size)} for f in fits}
        wanted = [(f, 1) for f in fits]
        known = dict(zip(wanted, zip(*histogram(wanted, now))))
        for f in fits:
            w, s = known[f, 1]
            now[f]["value"][1] = s[0].sum() / max(w[0].sum(), 1e-300)
        for level in range(depth):
            if not known:
                break
            pairs = list(known)
            w, s = (np.array([known[p][k] for p in pairs]) for k in (0, 1))
            feature, last, gain = best_bins(w, s)
            wanted, other = [], {}
            for i, (f, k) in enumerate(pairs):
                j, b = int(feature[i]), int(last[i])
                if j < 0 or gain[i] <= 1e-12 * max(1e-300, float(np.abs(s[i, j]).sum()) ** 2 / w[i, j].sum()):
                    continue
                t = now[f]
                t["feature"][k], t["last"][k], t["gain"][k] = j, b, gain[i]
                lw, ls = w[i, j, :b + 1].sum(), s[i, j, :b + 1].sum()
                rw, rs = w[i, j, b + 1:].sum(), s[i, j, b + 1:].sum()
                t["value"][2 * k], t["value"][2 * k + 1] = ls / lw, rs / rw
                light = 2 * k + int(rw < lw)
                wanted.append((f, light))
                other[f, light] = (f, light ^ 1), w[i], s[i]
            known = {}
            if wanted and level + 1 < depth:
                for p, pw, ps in zip(wanted, *histogram(wanted, now)):
                    sibling, w0, s0 = other[p]
                    known[p], known[sibling] = (pw, ps), (w0 - pw, s0 - ps)
        done(now)
        for f in fits:
            for name, v in now[f].items():
                out[f][name].append(v)
    return {f: {name: np.array(v) for name, v in t.items()} for f, t in out.items()}


def heap_node(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The node (heap order) of one boosted tree that each row of ``bins`` reaches."""
    at = np.ones(len(bins), np.int64)
    while True:
        on = np.flatnonzero(tree["feature"][at] >= 0)
        if not len(on):
            return at
        k = at[on]
        at[on] = 2 * k + (bins[on, tree["feature"][k]] > tree["last"][k])


def heap_values(model: dict, bins: np.ndarray, start: int = 0) -> np.ndarray:
    """Sum of the values of the trees from ``start`` on."""
    total = np.zeros(len(bins))
    for t in range(start, len(model["feature"])):
        tree = {k: model[k][t] for k in ("feature", "last", "value")}
        total += tree["value"][heap_node(tree, bins)]
    return total


def bins_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: the number of edges below it."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) \
        if len(edges) else np.zeros((len(x), 0), np.int64)


def node_histograms(bins: np.ndarray, r: np.ndarray, w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and weighted targets of the rows by (feature, bin)."""
    d = bins.shape[1]
    cell = (bins + np.arange(d) * width).ravel()
    return tuple(np.bincount(cell, weights=np.repeat(v, d), minlength=d * width).reshape(d, width) for v in (w, w * r))

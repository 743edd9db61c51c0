"""Fitted trees as plain arrays: scoring, partial dependence and attribution kernels.

These are the small vectorised helpers that run on Arrow batches inside tasks.  They
work on rows of a batch at once; Spark does the partitioning and the merging.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

GROUP_NODES = 2_000_000


@dataclass(frozen=True)
class Tree:
    """Nodes by position, the root first; ``feature`` is -1 in a leaf.  Rows at or below the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            goes_left = x[inner, self.feature[node]] <= self.threshold[node]
            at[inner] = np.where(goes_left, self.left[node], self.right[node])

    def sums_from(self, x: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """What each row gets from trees that share these arrays and begin at ``roots``, added up."""
        at = np.tile(roots, len(x))
        row = np.repeat(np.arange(len(x)), len(roots))
        inner = np.flatnonzero(self.feature[at] >= 0)
        while len(inner):
            node = at[inner]
            goes_left = x[row[inner], self.feature[node]] <= self.threshold[node]
            at[inner] = np.where(goes_left, self.left[node], self.right[node])
            inner = inner[self.feature[at[inner]] >= 0]
        return self.value[at].reshape(len(x), len(roots)).sum(axis=1)

    def mean(self) -> float:
        """Average value over the training rows."""
        leaves = self.feature < 0
        return float(np.average(self.value[leaves], weights=self.cover[leaves]))


@dataclass(frozen=True)
class Forest:
    """Weighted trees; predictions are summed, or combined by their weighted median."""

    trees: list[Tree]
    weights: list[float]
    combine: str = "sum"

    def predict(self, x: np.ndarray) -> np.ndarray:
        each = np.stack([t.value[t.leaf_of(x)] for t in self.trees], axis=1)
        weights = np.asarray(self.weights)
        return each @ weights if self.combine == "sum" else weighted_median(each, weights)

    def base_value(self) -> float:
        return sum(w * t.mean() for t, w in zip(self.trees, self.weights))

    def groups(self, nodes: int = GROUP_NODES) -> list["Forest"]:
        """The forest in parts of bounded size, so that each can be sent to every task."""
        parts, trees, weights, size = [], [], [], 0
        for tree, weight in zip(self.trees, self.weights):
            if trees and size + len(tree.feature) > nodes:
                parts.append(Forest(trees, weights, self.combine))
                trees, weights, size = [], [], 0
            trees.append(tree)
            weights.append(weight)
            size += len(tree.feature)
        return [*parts, Forest(trees, weights, self.combine)] if trees else parts


def weighted_median(each: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Along the second axis, the smallest value that half of the weight does not exceed."""
    order = np.argsort(each, axis=1, kind="stable")
    reached = np.cumsum(weights[order], axis=1)
    first = (reached >= 0.5 * reached[:, -1:]).argmax(axis=1)
    return np.take_along_axis(each, np.take_along_axis(order, first[:, None], axis=1), axis=1)[:, 0]


#: Numbers held at once while the medians of a sweep are found.
SWEEP_CELLS = 1 << 22


def reachable(tree: Tree, x: np.ndarray, feature: int, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, float]]:
    """Rows, first and last interval (end exclusive) and value of the leaves that rows reach as ``feature`` varies.

    Interval i holds the values above cuts[i - 1] and up to cuts[i].  A split on ``feature`` sends all rows both ways
    and shares out the intervals; any other split shares out the rows.  Each row is met once per leaf it can reach,
    however many values are asked for.
    """
    stack = [(0, np.arange(len(x)), 0, len(cuts) + 1)]
    while stack:
        node, rows, low, high = stack.pop()
        split = tree.feature[node]
        if split < 0:
            yield rows, low, high, float(tree.value[node])
            continue
        left, right = int(tree.left[node]), int(tree.right[node])
        if split == feature:
            middle = int(np.searchsorted(cuts, tree.threshold[node])) + 1
            ways = ((left, rows, low, min(high, middle)), (right, rows, max(low, middle), high))
        else:
            goes_left = x[rows, split] <= tree.threshold[node]
            ways = ((left, rows[goes_left], low, high), (right, rows[~goes_left], low, high))
        stack.extend(way for way in ways if len(way[1]) and way[2] < way[3])


def dependence_sums(forest: Forest, x: np.ndarray, feature: int, grid: np.ndarray, cells: int = SWEEP_CELLS) -> np.ndarray:
    """For each grid value, the predictions of all rows with ``feature`` set to it, added up.

    Trees are constant between their thresholds, so the forest is walked once per row and feature, not once per grid value.
    """
    at = [t.threshold[t.feature == feature] for t in forest.trees]
    cuts = np.unique(np.concatenate(at)) if at else np.empty(0)
    weights = np.asarray(forest.weights, float)
    sums = np.zeros(len(cuts) + 1)
    if forest.combine == "sum":
        for tree, weight in zip(forest.trees, weights):
            for rows, low, high, value in reachable(tree, x, feature, cuts):
                sums[low:high] += weight * value * len(rows)
    else:
        # only intervals that hold a grid value matter to the medians
        wanted, place = np.unique(np.searchsorted(cuts, grid), return_inverse=True)
        step = max(1, cells // max(1, len(weights) * len(wanted)))
        for start in range(0, len(x), step):
            part = x[start : start + step]
            each = np.empty((len(part), len(weights), len(wanted)))
            for t, tree in enumerate(forest.trees):
                for rows, low, high, value in reachable(tree, part, feature, cuts):
                    first, last = np.searchsorted(wanted, [low, high])
                    each[rows, t, first:last] = value
            sums[wanted] += weighted_median(each, weights).sum(axis=0)
        return sums[wanted][place]
    return sums[np.searchsorted(cuts, grid)]


def partial_dependence(tree: Tree, feature: int, grid: np.ndarray) -> np.ndarray:
    """Average prediction with ``feature`` set to each grid value.

    Splits on other features are followed both ways, in the proportions of the training
    rows, so no data is read.
    """
    reach = {0: np.ones(len(grid))}
    result = np.zeros(len(grid))
    while reach:
        node, share = reach.popitem()
        if tree.feature[node] < 0:
            result += share * tree.value[node]
            continue
        left, right = int(tree.left[node]), int(tree.right[node])
        if tree.feature[node] == feature:
            to_left = grid <= tree.threshold[node]
        else:
            to_left = np.full(len(grid), tree.cover[left] / tree.cover[node])
        reach[left], reach[right] = share * to_left, share * (1.0 - to_left)
    return result


#: Features on the path to a leaf up to which all patterns of decisions are worked out beforehand.
TABLE_FEATURES = 8
#: Splits of a tree up to which rows are told apart by their sides of all of them.
KIND_SPLITS = 16


@dataclass(frozen=True)
class Leaf:
    """The way to a leaf: its features, the range that each must lie in, and the share of training rows that does."""

    features: list[int]
    ranges: list[tuple[float, float]]
    shares: np.ndarray
    value: float


def leaves(tree: Tree) -> list[Leaf]:
    found, stack = [], [(0, {})]
    while stack:
        node, path = stack.pop()
        split = int(tree.feature[node])
        if split < 0:
            if path and tree.value[node] != 0.0:
                names = list(path)
                shares = np.asarray([path[f][0] for f in names])
                found.append(Leaf(names, [path[f][1:] for f in names], shares, float(tree.value[node])))
            continue
        share, low, high = path.get(split, (1.0, -np.inf, np.inf))
        cut, left, right = float(tree.threshold[node]), int(tree.left[node]), int(tree.right[node])
        for child, ends in ((left, (low, min(high, cut))), (right, (max(low, cut), high))):
            stack.append((child, {**path, split: (share * tree.cover[child] / tree.cover[node], *ends)}))
    return found


def attributions(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Path-dependent Shapley values of one tree, rows by features.

    Rows on the same side of every split of the tree get the same values, so of many rows that meet few splits one of
    each kind is enough.
    """
    inner = np.flatnonzero(tree.feature >= 0)
    if len(inner) > KIND_SPLITS or len(x) <= 1 << len(inner) // 2:
        return _attributions(tree, x)
    kind = np.zeros(len(x), np.int32)
    columns = np.ascontiguousarray(x.T)
    for f, cut in zip(tree.feature[inner].tolist(), tree.threshold[inner].tolist()):
        kind += kind
        kind += columns[f] <= cut
    first = np.full(1 << len(inner), -1, np.int32)
    first[kind] = np.arange(len(x), dtype=np.int32)  # any row of a kind
    some = first[first >= 0]
    found = _attributions(tree, x[some]).T
    first[kind[some]] = np.arange(len(some), dtype=np.int32)
    place = first.take(kind)
    result = np.zeros(columns.shape)
    for f in np.unique(tree.feature[inner]):
        result[f] = found[f].take(place)
    return result.T


def _attributions(tree: Tree, x: np.ndarray) -> np.ndarray:
    """``attributions`` row by row.

    What a leaf gives to the features on its path depends on a row only through which of them lie in the leaf's
    ranges.  This pattern of decisions is a number, and the values of a pattern are looked up: in a table of all
    patterns for short paths, in one of the patterns that occur for longer ones.
    """
    columns = np.ascontiguousarray(x.T)
    result = np.zeros(columns.shape)
    found = leaves(tree)
    tables = _pattern_tables(found)
    for number, leaf in enumerate(found):
        d = len(leaf.features)
        pattern = np.zeros(len(x), dtype=np.int16 if d <= TABLE_FEATURES else np.int64)
        for place, (f, (low, high)) in enumerate(zip(leaf.features, leaf.ranges)):
            inside = columns[f] <= high if high < np.inf else ~(columns[f] <= low)
            if low > -np.inf and high < np.inf:
                inside &= columns[f] > low
            pattern += inside * pattern.dtype.type(1 << place)
        if d <= TABLE_FEATURES:
            values = tables[number]
        else:
            patterns, pattern = np.unique(pattern, return_inverse=True)
            values = _pattern_values(_decisions(patterns, d), leaf.shares[None], np.asarray([leaf.value]))[0]
        for f, column in zip(leaf.features, values.T):
            result[f] += np.take(column, pattern)
    return result.T


def _decisions(patterns: np.ndarray, d: int) -> np.ndarray:
    return (patterns[:, None] >> np.arange(d) & 1).astype(float)


def _pattern_tables(found: list[Leaf]) -> dict[int, np.ndarray]:
    """By the number of the leaf the values of all patterns, for leaves with short paths; leaves of one length together."""
    lengths: dict[int, list[int]] = {}
    for number, leaf in enumerate(found):
        lengths.setdefault(len(leaf.features), []).append(number)
    tables: dict[int, np.ndarray] = {}
    for d, numbers in lengths.items():
        if d <= TABLE_FEATURES:
            seen = _decisions(np.arange(1 << d), d)
            shares = np.stack([found[i].shares for i in numbers])
            tables.update(zip(numbers, _pattern_values(seen, shares, np.asarray([found[i].value for i in numbers]))))
    return tables


def _pattern_values(seen: np.ndarray, shares: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What each pattern gives to each feature, for leaves whose paths have as many features: leaf, pattern, feature.

    A feature of the path is either known (the row is in range or not) or unknown (the training share decides).
    Averaging over all orders of learning features needs, for each number of known ones, the summed products of these
    factors over all others.
    """
    count, d = shares.shape
    out = np.empty((count, *seen.shape))
    weights = _order_weights(d - 1)
    for i in range(d):
        others = [j for j in range(d) if j != i]
        # known[k]: sum over the sets of k known others of the product of all factors
        known = np.zeros((d, count, len(seen)))
        known[0] = 1.0
        for size, j in enumerate(others, start=1):
            share = shares[:, j, None]
            known[1 : size + 1] = known[1 : size + 1] * share + known[:size] * seen[:, j]
            known[0] *= share
        out[:, :, i] = value[:, None] * (seen[:, i] - shares[:, i, None]) * np.tensordot(weights, known, 1)
    return out


def _order_weights(others: int) -> np.ndarray:
    """Chance that exactly a given set of k others precedes a feature: k! (n-k)! / (n+1)!."""
    weights = np.ones(others + 1)
    for k in range(1, others + 1):
        weights[k] = weights[k - 1] * k / (others - k + 1)
    return weights / (others + 1)

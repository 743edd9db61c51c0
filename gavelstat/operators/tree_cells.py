"""Regression trees from counted cells: choosing cuts, growing the trees of one block of rows.

A cell is (node, bin of a feature) with its rows, weight and weighted sum of targets.  A cut after a bin is judged by
what it takes off the squared error.  The same choice serves cells counted inside a task and cells that Spark has
added up over all tasks (``tree_growth``), so trees do not depend on where a node is finished.

Everything random is a hash of (seed, tree, node, feature) or of (seed, tree, row), never a generator's state.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

import numpy as np

#: Gains this close, relatively, count as equal; then the feature tried first and its lowest cut win.
TIE = 1e-9
#: Squared error per row, relative to that of all rows, from which a node counts as pure.
PURE = 1e-12
#: Cells for each row up to which all cells of a level are kept, empty ones too.
DENSE = 2
#: Share of the rows on their way down a tree from which those that have arrived are carried along.
FEW_GOING = 0.7
#: Cells of the deepest level up to which those of all nodes are kept, so that a node's larger child has its parent's less the smaller's.
HELD_CELLS = 1 << 20
#: Combinations of the bins of features that are counted together.
JOINT_CELLS = 1 << 13
#: Gain per weight, relative to the squared error per row of all rows, from which a node is known not to be pure.
PLAIN_GAIN = 1e-9


def mix(values) -> np.ndarray:
    """64 well-mixed bits for each integer."""
    with np.errstate(over="ignore"):
        x = np.asarray(values, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(*parts) -> np.ndarray:
    """A number in [0, 1) from the hash of several integers or arrays of them."""
    x = mix(parts[0])
    for part in parts[1:]:
        x = mix(x ^ mix(part))
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def tree_key(seed: int, tree: int) -> np.uint64:
    """The hash that stands for the root of a tree."""
    return mix(mix(np.uint64(seed)) ^ mix(np.uint64(tree)))


def child_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return mix(keys + np.uint64(1)), mix(keys + np.uint64(2))


def poisson_steps(mean: float) -> list[float]:
    """The probabilities of at most 0, 1, 2, ... of a Poisson number."""
    out, p, total, k = [], float(np.exp(-mean)), 0.0, 0
    while k <= mean or p > 2.0**-60:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return out


def poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson numbers by inverting their distribution at ``u``."""
    out = np.zeros(len(u))
    for step in poisson_steps(mean):
        out += u > step
    return out


@dataclass(frozen=True)
class Rules:
    """How far a tree grows."""

    depth: int | None = None
    min_leaf: int = 1
    min_split: int = 2
    #: Features drawn for a node; more only where none of these can split it.  None: all, in order.
    tried: int | None = None
    #: Grow best leaf first up to this many leaves.
    leaves: int | None = None
    #: One random cut per feature, between its least and greatest value in the node.
    random_cuts: bool = False
    #: Whether a cut has to take something off the error.
    strict: bool = False

    def may_split(self, rows: np.ndarray) -> np.ndarray:
        return rows >= max(self.min_split, 2 * self.min_leaf)


@dataclass
class Nodes:
    """A tree by position, the root first; ``feature`` is -1 in a leaf, rows up to ``cut`` go left."""

    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)
    cover: list = field(default_factory=list)

    def arrays(self) -> tuple[np.ndarray, ...]:
        kinds = (np.int16, np.int32, np.int32, np.int32, float, float)
        return tuple(np.asarray(v, k) for v, k in zip(vars(self).values(), kinds))


@dataclass(frozen=True)
class Cuts:
    """For each of some nodes the chosen cut; ``gain`` is -inf where there is none.  ``left``: rows, weight, sum."""

    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    left: np.ndarray


# ---- choosing cuts ----


def cuts_of_cells(node, bin_, sums, k: int, rules: Rules, drawn: tuple[np.ndarray, np.ndarray] | None = None):
    """Best cut per node of one feature: gain, bin, and rows, weight and sum on the left.

    Cells are sorted by node, then bin; ``sums`` are their rows, weights and sums of targets, the first two one array where
    rows have no weights.  For random cuts ``drawn`` gives a number per node and, per node and bin, the value that the
    bin stands for.
    """
    gain, at = np.full(k, -np.inf), np.zeros(k, np.int64)
    left_out = np.zeros((k, 3))
    if not len(node):
        return gain, at, left_out
    count, weight, total = sums
    weighted = weight is not count
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    size = np.diff(np.append(first, len(node)))
    last = first + size - 1

    def sides(v):
        upto = np.cumsum(v)
        left = upto - np.repeat(upto[first] - v[first], size)
        return left, left[last]

    left_n, all_n = sides(count)
    least = max(rules.min_leaf, 1)
    ok = (left_n >= least) & (np.repeat(all_n, size) - left_n >= least) & (count > 0)
    left_w, all_w = sides(weight) if weighted else (left_n, all_n)
    if weighted:
        ok &= (left_w > 0) & (np.repeat(all_w, size) - left_w > 0)
    owner = np.repeat(np.arange(len(first)), size)
    if rules.random_cuts:
        some = count > 0
        value = drawn[1][node, bin_]
        low = np.minimum.reduceat(np.where(some, value, np.inf), first)
        high = np.maximum.reduceat(np.where(some, value, -np.inf), first)
        reached = low + drawn[0][node[first]] * (high - low)
        # the last occupied bin that the drawn value reaches
        at_most = np.where(some & (value <= reached[owner]), bin_, -1)
        ok &= bin_ == np.maximum.reduceat(at_most, first)[owner]
    left_s, all_s = sides(total)
    inside = np.flatnonzero(ok)
    if not len(inside):
        return gain, at, left_out
    owner, left_w, left_s = owner[inside], left_w[inside], left_s[inside]
    score = left_s**2 / left_w + (all_s[owner] - left_s) ** 2 / (all_w[owner] - left_w) - (all_s**2 / np.where(all_w > 0, all_w, 1))[owner]
    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    best = np.maximum.reduceat(score, begin)
    close = np.flatnonzero(score >= np.repeat(best - TIE * np.abs(best), np.diff(np.append(begin, len(owner)))))
    where = close[np.concatenate(([True], owner[close[1:]] != owner[close[:-1]]))]
    pick, nodes = inside[where], node[first][owner[where]]
    gain[nodes], at[nodes] = score[where], bin_[pick]
    left_out[nodes] = np.stack([left_n[pick], left_w[where], left_s[where]], axis=1)
    return gain, at, left_out


def cells_of_rows(slot: np.ndarray, bins: np.ndarray, y: np.ndarray, w: np.ndarray | None, widths: np.ndarray):
    """Cells of one feature of each node over rows in nodes, whose numbers of bins are ``widths``: node, bin, and rows,
    weights, sums of weighted targets."""
    base = np.concatenate(([0], np.cumsum(widths)))
    top = int(base[-1])
    key = base[slot] + bins
    wy = y if w is None else w * y
    if top <= DENSE * len(key):
        n = np.bincount(key, minlength=top).astype(float)
        weight = n if w is None else np.bincount(key, w, top)
        node = np.repeat(np.arange(len(widths)), widths)
        return node, np.arange(top) - base[node], (n, weight, np.bincount(key, wy, top))
    order, key = sorted_order(key, top)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(first, len(key))).astype(float)
    weight = n if w is None else np.add.reduceat(w[order], first)
    node = np.searchsorted(base, key[first], side="right") - 1
    return node, key[first] - base[node], (n, weight, np.add.reduceat(wy[order], first))


def sorted_order(key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of whole numbers below ``top``, and the numbers in it: they are sorted with their places behind them."""
    bits = max(len(key) - 1, 1).bit_length()
    if int(top).bit_length() + bits > 62:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort(key << bits | np.arange(len(key)))
    return both & ((1 << bits) - 1), both >> bits


@dataclass(frozen=True)
class Runs:
    """Rows sorted by node: where each node's begin and how many they are, its number, its rows, weight and sum of targets."""

    first: np.ndarray
    size: np.ndarray
    nodes: np.ndarray
    wy: np.ndarray
    w: np.ndarray | None
    all_n: np.ndarray
    all_w: np.ndarray
    all_s: np.ndarray

    @classmethod
    def of(cls, slot: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> Runs:
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        size, wy = np.diff(np.append(first, len(slot))), y if w is None else w * y
        all_n = size.astype(float)
        return cls(first, size, slot[first], wy, w, all_n, all_n if w is None else np.add.reduceat(w, first), np.add.reduceat(wy, first))


def random_cuts_of_rows(runs: Runs, bins: np.ndarray, feature: np.ndarray, values: np.ndarray, k: int, rules: Rules, drawn: np.ndarray):
    """``cuts_of_cells`` for random cuts, from the bins of rows that are sorted by node: no cells are needed.

    ``feature`` is that of each node, ``values`` what its bins stand for, in ascending order.  The bin of a cut may be empty.
    """
    gain, at, left_out = np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros((k, 3))
    first, nodes = runs.first, runs.nodes
    low, high, mine = np.minimum.reduceat(bins, first), np.maximum.reduceat(bins, first), feature[nodes]
    least_value = values[mine, low]
    reached = least_value + drawn[nodes] * (values[mine, high] - least_value)
    # the last bin that the drawn value reaches
    last = np.empty(len(nodes), bins.dtype)
    for f in np.unique(mine):
        some = np.flatnonzero(mine == f)
        last[some] = np.searchsorted(values[f], reached[some], side="right") - 1
    at[nodes] = np.minimum(last, high)
    below = bins <= np.repeat(np.minimum(last, high), runs.size)

    def left(v):
        return np.add.reduceat(v * below, first)

    left_n = np.add.reduceat(below, first, dtype=np.int32).astype(float)
    left_w, left_s = left_n if runs.w is None else left(runs.w), left(runs.wy)
    least = max(rules.min_leaf, 1)
    ok = (left_n >= least) & (runs.all_n - left_n >= least) & (left_w > 0) & (runs.all_w - left_w > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = left_s**2 / left_w + (runs.all_s - left_s) ** 2 / (runs.all_w - left_w) - runs.all_s**2 / runs.all_w
    gain[nodes] = np.where(ok, score, -np.inf)
    left_out[nodes] = np.stack([left_n, left_w, left_s], axis=1)
    return gain, at, left_out


def feature_order(keys: np.ndarray, p: int, rules: Rules) -> np.ndarray:
    """For each node the features in the order in which they are tried."""
    if rules.tried is None or rules.tried >= p:
        return np.broadcast_to(np.arange(p), (len(keys), p))
    return np.argsort(mix(keys[:, None] ^ mix(np.arange(p))[None, :]), axis=1, kind="stable")


def chosen(order: np.ndarray, gain: np.ndarray, bins: np.ndarray, left: np.ndarray, rules: Rules) -> Cuts:
    """The cut of each node from those of its features, given by feature: the drawn ones first."""
    k, p = order.shape
    rows = np.arange(k)[:, None]
    in_order = gain[rows, order]
    step = rules.tried or p
    pick = np.full(k, -1)
    for low in range(0, p, step):
        part = in_order[:, low : low + step]
        best = part.max(axis=1)
        first = (part >= (best - TIE * np.abs(best))[:, None]).argmax(axis=1) + low
        pick = np.where((pick < 0) & np.isfinite(best), first, pick)
    feature = order[np.arange(k), np.maximum(pick, 0)]
    at = (np.arange(k), feature)
    found = np.where(pick >= 0, gain[at], -np.inf)
    if rules.strict:
        found = np.where(found > 1e-12, found, -np.inf)
    return Cuts(feature, bins[at], found, left[at])


def search(x, rows, slot, y, w, keys, widths, rules: Rules, values=None) -> Cuts:
    """The cut of every node (hash in ``keys``) over ``rows`` of x, whose node is ``slot``; y and w are theirs.  Random
    cuts want the rows sorted by node.

    Features beyond the drawn ones are looked at only where needed.
    """
    p, k = len(x), len(keys)
    order = feature_order(keys, p, rules)
    step = rules.tried or p
    gain, bins, left = np.full((k, p), -np.inf), np.zeros((k, p), np.int64), np.zeros((k, p, 3))
    open_ = np.arange(k)
    flat, length, wide = x.reshape(-1), x.shape[1], np.asarray(widths)
    for low in range(0, p, step):
        if len(open_) < k:
            number = np.full(k, -1)
            number[open_] = np.arange(len(open_))
            inside = np.flatnonzero(number[slot] >= 0)
            s, rr, yy, ww = number[slot[inside]], rows[inside], y[inside], None if w is None else w[inside]
        else:
            s, rr, yy, ww = slot, rows, y, w
        runs = Runs.of(s, yy, ww) if rules.random_cuts else None
        for place in range(low, min(low + step, p)):
            f = order[open_, place]
            same = bool((f == f[0]).all())
            b = x[f[0]].take(rr) if same else flat.take((f * length)[s] + rr)
            if runs is not None:
                found = random_cuts_of_rows(runs, b, f, values, len(open_), rules, uniform(keys[open_], f))
            else:
                found = cuts_of_cells(*cells_of_rows(s, b, yy, ww, wide[f]), len(open_), rules)
            gain[open_, f], bins[open_, f], left[open_, f] = found
        open_ = open_[~np.isfinite(gain[open_]).any(axis=1)]
        if not len(open_):
            break
    cuts = chosen(order, gain, bins, left, rules)
    if rules.random_cuts:
        # the last bin up to the cut that has rows
        b = flat.take((cuts.feature * length)[slot] + rows)
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        cuts = replace(cuts, bin=np.maximum.reduceat(np.where(b <= cuts.bin[slot], b, 0), first).astype(np.int64))
    return cuts


# ---- growing on the rows of one block ----


@dataclass(frozen=True)
class Joint:
    """Features counted together, widest first: their numbers of bins, and each row's combination of bins as one number."""

    features: list[int]
    widths: list[int]
    key: np.ndarray


def joints(x: np.ndarray, widths: list[int], most: int = JOINT_CELLS) -> list[Joint]:
    """Features of few bins in groups of at most ``most`` combinations; a feature with more bins is a group of its own."""
    groups: list[list[int]] = []
    sizes: list[int] = []
    for f in sorted(range(len(widths)), key=lambda f: -widths[f]):
        at = next((i for i, size in enumerate(sizes) if size * widths[f] <= most), len(groups))
        if at == len(groups):
            groups.append([])
            sizes.append(1)
        groups[at].append(f)
        sizes[at] *= widths[f]
    out = []
    for group in groups:
        key = x[group[0]].astype(np.intp)
        for f in group[1:]:
            key *= widths[f]
            key += x[f]
        out.append(Joint(group, [widths[f] for f in group], key))
    return out


@dataclass(frozen=True)
class Block:
    """Rows of one block: ``x`` holds a row of bins per feature, ``widths`` their numbers, ``values`` what their bins stand for."""

    x: np.ndarray
    y: np.ndarray
    widths: list[int]
    values: np.ndarray | None = None
    w: np.ndarray | None = None
    #: Rows of each bin, all features behind each other, where they are known.
    counts: np.ndarray | None = None
    #: The features in groups that are counted together, where that has been worked out.
    joint: list[Joint] | None = None

    def take(self, rows: np.ndarray) -> Block:
        joint = None if self.joint is None else [replace(j, key=j.key.take(rows)) for j in self.joint]
        return replace(self, x=self.x.take(rows, axis=1), y=self.y[rows], w=None if self.w is None else self.w[rows], counts=None, joint=joint)

    def counted_together(self) -> Block:
        """The same block, ready to be counted often."""
        return replace(self, joint=joints(self.x, self.widths))

    def offsets(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.widths)))

    def histogram(self, rows: np.ndarray | None = None) -> np.ndarray:
        """Rows, weights and sums of weighted targets of each bin, over all rows or some."""
        offsets = self.offsets()
        y, w = (v if v is None or rows is None else v.take(rows) for v in (self.y, self.w))
        wy = y if w is None else w * y
        known = self.counts if rows is None else None
        out = np.empty((3, offsets[-1]))
        wanted = [i for i, there in enumerate((known is None, w is not None, True)) if there]
        for joint in joints(self.x, self.widths, 1) if self.joint is None else self.joint:
            key = joint.key if rows is None else joint.key.take(rows)
            size = int(np.prod(joint.widths))
            cells = np.stack([np.bincount(key, (None, w, wy)[i], size) for i in wanted])
            for f, width in zip(joint.features, joint.widths):
                cells = cells.reshape(len(wanted), width, -1)
                out[wanted, offsets[f] : offsets[f + 1]] = cells.sum(axis=2)
                cells = cells.sum(axis=1)
        if known is not None:
            out[0] = known
        if w is None:
            out[1] = out[0]
        return out


def _error(slot: np.ndarray, totals: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    """Squared error per unit of weight of every node."""
    squares = np.bincount(slot, y * y if w is None else w * y * y, len(totals))
    return squares / totals[:, 1] - (totals[:, 2] / totals[:, 1]) ** 2


def grow(block: Block, rules: Rules, key: np.uint64, depth: int = 0) -> tuple[Nodes, np.ndarray]:
    """A tree from the node with hash ``key`` at ``depth`` down, and the leaf of every row."""
    if rules.leaves is not None:
        return _grow_best_first(block, rules, key)
    bins, cut_all = sum(block.widths), not rules.random_cuts and (rules.tried is None or rules.tried >= len(block.x))
    if cut_all and rules.depth is not None and bins << max(rules.depth - depth, 0) <= HELD_CELLS and len(block.y) >= bins:
        return _grow_by_halves(block, rules, key, depth)
    arrays, _, leaf = _grow_levels(block, rules, np.asarray([key], np.uint64), depth)
    return Nodes(*arrays), leaf


def grow_together(block: Block, rules: Rules, keys: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Trees of all ``keys`` over the same rows without weights, level by level side by side.

    Node arrays of one tree behind the other, each as ``grow`` makes it, and the numbers of their nodes.  Small blocks
    cost a step of the interpreter per level of all trees, not of each.
    """
    arrays, root, _ = _grow_levels(block, rules, np.asarray(keys, np.uint64), 0)
    order = np.argsort(root, kind="stable")
    sizes = np.bincount(root, minlength=len(keys))
    # a tree's nodes are numbered by their place among its own
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    feature, cut, left, right, value, cover = (v[order] for v in arrays)
    left, right = (np.where(v >= 0, number[np.maximum(v, 0)], -1).astype(np.int32) for v in (left, right))
    return (feature, cut, left, right, value, cover), sizes


def _grow_levels(block: Block, rules: Rules, keys: np.ndarray, depth: int):
    """Node arrays by level, the root of each node, and the node that each row of the last tree ends in."""
    n, count = len(block.y), len(keys)
    rows, slot = np.tile(np.arange(n), count), np.repeat(np.arange(count), n)
    y, w = block.y[rows], None if block.w is None else block.w[rows]
    leaf = np.zeros(n, np.int64)
    weight = float(n if w is None else block.w.sum())
    totals = np.tile([[float(n), weight, float((block.y if w is None else block.w * block.y).sum())]], (count, 1))
    whole = np.maximum(_error(slot, totals, y, w), 0.0)
    root, base, levels, roots = np.arange(count), 0, [], []
    while len(keys):
        k = len(keys)
        leaf[rows] = base + slot
        feature, cut, left, right = np.full(k, -1, np.int16), np.zeros(k, np.int32), np.full(k, -1, np.int32), np.full(k, -1, np.int32)
        levels.append((feature, cut, left, right, totals[:, 2] / totals[:, 1], totals[:, 1]))
        roots.append(root)
        if rules.depth is not None and depth >= rules.depth:
            break
        open_ = np.flatnonzero(rules.may_split(totals[:, 0]) & (_error(slot, totals, y, w) > PURE * whole[root]))
        if not len(open_):
            break
        if len(open_) < k:
            number = np.full(k, -1)
            number[open_] = np.arange(len(open_))
            stay = np.flatnonzero(number[slot] >= 0)
            rows, slot, y, w = rows[stay], number[slot[stay]], y[stay], None if w is None else w[stay]
        cuts = search(block.x, rows, slot, y, w, keys[open_], block.widths, rules, block.values)
        split = np.flatnonzero(np.isfinite(cuts.gain))
        children, at = base + k + 2 * np.arange(len(split)), open_[split]
        feature[at], cut[at], left[at], right[at] = cuts.feature[split], cuts.bin[split], children, children + 1
        number = np.full(len(open_), -1)
        number[split] = np.arange(len(split))
        goes_right = block.x.reshape(-1).take(cuts.feature[slot] * n + rows) > cuts.bin[slot]
        place = 2 * number[slot] + goes_right
        if len(split) < len(open_):
            stay = np.flatnonzero(place >= 0)
            rows, place, y, w = rows[stay], place[stay], y[stay], None if w is None else w[stay]
        slot = place
        if rules.random_cuts and len(place):
            order, slot = sorted_order(place, 2 * len(split))
            rows, y, w = rows[order], y[order], None if w is None else w[order]
        lower = cuts.left[split]
        totals = np.stack([lower, totals[at] - lower], axis=1).reshape(-1, 3)
        keys, root = np.stack(child_keys(keys[at]), axis=1).reshape(-1), np.repeat(root[at], 2)
        base += k
        depth += 1
    return tuple(np.concatenate(c) for c in zip(*levels)), np.concatenate(roots), leaf


def _grow_by_halves(block: Block, rules: Rules, key: np.uint64, depth: int) -> tuple[Nodes, np.ndarray]:
    """``_grow_levels`` for few levels and cuts among all features: only the smaller child of a node is counted."""
    y, w, offsets = block.y, block.w, block.offsets()
    squares = y * y if w is None else w * y * y
    leaf, levels, base = np.zeros(len(y), np.int64), [], 0
    weight = float(len(y) if w is None else w.sum())
    totals = np.asarray([[float(len(y)), weight, float((y if w is None else w * y).sum())]])
    open_ = [(np.arange(len(y)), block.histogram() if depth < rules.depth else None, np.uint64(key))]  # rows, cells and hash of each node

    def error(rows, total):
        whole = squares.sum() if len(rows) == len(y) else squares.take(rows).sum()
        return whole / total[1] - (total[2] / total[1]) ** 2

    whole = max(error(open_[0][0], totals[0]), 0.0)
    while open_:
        k = len(open_)
        feature, cut, left, right = np.full(k, -1, np.int16), np.zeros(k, np.int32), np.full(k, -1, np.int32), np.full(k, -1, np.int32)
        levels.append((feature, cut, left, right, totals[:, 2] / totals[:, 1], totals[:, 1]))
        below, sums = [], []
        splits = np.asarray([c is not None for _, c, _ in open_]) & rules.may_split(totals[:, 0])
        at_cuts = dict(zip(np.flatnonzero(splits).tolist(), range(k)))
        cuts = _cuts_of_histograms([open_[i][1] for i in at_cuts], offsets, [open_[i][2] for i in at_cuts], rules) if at_cuts else None
        for at, (rows, cells, node_key) in enumerate(open_):
            i = at_cuts.get(at)
            if i is None or not np.isfinite(cuts.gain[i]) or _pure(cuts.gain[i], totals[at], whole, lambda: error(rows, totals[at])):
                if rows is not None:
                    leaf[rows] = base + at
                continue
            feature[at], cut[at] = cuts.feature[i], cuts.bin[i]
            left[at], right[at] = base + k + len(below), base + k + len(below) + 1
            lower = cuts.left[i]
            sums += [lower, totals[at] - lower]
            further = depth + 1 < rules.depth and bool(rules.may_split(np.asarray(sums[-2:])[:, 0]).any())
            goes_right = block.x[cuts.feature[i]].take(rows) > cuts.bin[i]
            if further:
                sides = [rows.compress(~goes_right), rows.compress(goes_right)]
                both = _cells_of_children(block, cells, sides)
            else:  # both children are leaves
                leaf[rows] = left[at] + goes_right
                sides = both = (None, None)
            below += zip(sides, both, (keys[0] for keys in child_keys(np.asarray([node_key], np.uint64))))
        base += k
        depth += 1
        open_, totals = below, np.asarray(sums)
    return Nodes(*(np.concatenate(c) for c in zip(*levels))), leaf


def _pure(gain: float, total: np.ndarray, whole: float, error) -> bool:
    """Whether a node counts as pure; its error, which no gain exceeds, is worked out only where the gain leaves that open."""
    return gain <= PLAIN_GAIN * whole * total[1] and error() <= PURE * whole


def _cells_of_children(block: Block, cells: np.ndarray, sides: list[np.ndarray]) -> list[np.ndarray]:
    """The cells of both sides of a node; only the side of fewer rows is counted."""
    small = int(len(sides[1]) < len(sides[0]))
    counted = block.histogram(sides[small])
    rest = cells - counted
    rest[:, rest[0] == 0] = 0.0
    return [rest, counted] if small else [counted, rest]


def _grow_best_first(block: Block, rules: Rules, key: np.uint64) -> tuple[Nodes, np.ndarray]:
    """Splits the leaf with the largest gain until there are ``rules.leaves`` of them."""
    nodes, leaf = Nodes(), np.zeros(len(block.y), np.int64)
    offsets = block.offsets()
    heap: list[tuple] = []

    def add(rows, cells, node_key, depth):
        at = len(nodes.feature)
        n, weight, total = cells[:, : offsets[1]].sum(axis=1)
        for part, v in zip(vars(nodes).values(), (-1, 0, -1, -1, total / weight, weight)):
            part.append(v)
        leaf[rows] = at
        if rules.may_split(n) and (rules.depth is None or depth < rules.depth):
            cuts = _cut_of_histogram(cells, offsets, node_key, rules)
            if np.isfinite(cuts.gain[0]):
                heapq.heappush(heap, (-cuts.gain[0], at, rows, cells, node_key, depth, int(cuts.feature[0]), int(cuts.bin[0])))
        return at

    add(np.arange(len(block.y)), block.histogram(), key, 0)
    leaves = 1
    while heap and leaves < rules.leaves:
        _, at, rows, cells, node_key, depth, f, b = heapq.heappop(heap)
        right = block.x[f].take(rows) > b
        parts = [rows.compress(~right), rows.compress(right)]
        both = _cells_of_children(block, cells, parts)
        keys = [k[0] for k in child_keys(np.asarray([node_key], np.uint64))]
        nodes.feature[at], nodes.cut[at] = f, b
        nodes.left[at], nodes.right[at] = [add(r, c, k, depth + 1) for r, c, k in zip(parts, both, keys)]
        leaves += 1
    return nodes, leaf


def _cut_of_histogram(cells: np.ndarray, offsets: np.ndarray, key: np.uint64, rules: Rules) -> Cuts:
    """The cut of one node from its cells of all features, one feature after the other."""
    return _cuts_of_histograms([cells], offsets, [key], rules)


def _cuts_of_histograms(cells: list[np.ndarray], offsets: np.ndarray, keys: list[np.uint64], rules: Rules) -> Cuts:
    """The cut of each node from its cells of all features, one feature after the other."""
    k, p = len(cells), len(offsets) - 1
    feature = np.repeat(np.arange(p), np.diff(offsets))
    bins = np.arange(int(offsets[-1])) - offsets[feature]
    number = (np.arange(k)[:, None] * p + feature).reshape(-1)
    count, total = (np.concatenate([c[i] for c in cells]) for i in (0, 2))
    weight = count if all(c[1] is c[0] or np.array_equal(c[0], c[1]) for c in cells) else np.concatenate([c[1] for c in cells])
    gain, at, left = cuts_of_cells(number, np.tile(bins, k), (count, weight, total), k * p, rules)
    order = feature_order(np.asarray(keys, np.uint64), p, rules)
    return chosen(order, gain.reshape(k, p), at.reshape(k, p), left.reshape(k, p, 3), rules)


# ---- sequences of trees ----


def boost(block: Block, row_hash: np.ndarray, rules: Rules, rounds: int, rate: float, share: float, seed: int):
    """Trees on the residuals of those before, one after the other, from the mean on; yields (nodes, scores of all rows).

    About a ``share`` of the rows, chosen by a hash of round and row, take part in a round.
    """
    score = np.full(len(block.y), float(np.average(block.y, weights=block.w)))
    if rules.tried is None or rules.tried >= len(block.x):
        block = block.counted_together()
    if share >= 1.0:
        block = replace(block, counts=block.histogram()[0])
    for number in range(rounds):
        rest = replace(block, y=block.y - score)
        key = tree_key(seed, number)
        if share < 1.0:
            some = np.flatnonzero(uniform(key, row_hash) < share)
            some = some if len(some) else np.arange(len(row_hash))
            nodes, _ = grow(rest.take(some), rules, key)
            leaf = leaves_of(nodes, block.x)
        else:
            nodes, leaf = grow(rest, rules, key)
        score = score + rate * np.asarray(nodes.value)[leaf]
        yield nodes, score


def leaves_of(nodes: Nodes, x: np.ndarray) -> np.ndarray:
    feature, cut, left, right, _, _ = nodes.arrays()
    length, inner = x.shape[1], feature >= 0
    at, flat = np.zeros(length, np.int64), np.ascontiguousarray(x).reshape(-1)
    begin, own = np.where(inner, feature, 0) * np.int64(length), np.arange(len(feature))
    # both children of every node; a leaf is its own child
    child = np.stack([np.where(inner, left, own), np.where(inner, right, own)], axis=1).reshape(-1).astype(np.int64)
    rows, node = np.arange(length), at
    while True:
        going = inner[node]
        count = int(np.count_nonzero(going))
        if not count:
            return at
        if count < FEW_GOING * len(rows):
            rows, node = rows[going], node[going]
        node = child[2 * node + (flat.take(begin[node] + rows) > cut[node])]
        if len(rows) < length:
            at[rows] = node
        else:
            at = node


@dataclass
class AdaState:
    """One round of AdaBoost.R2 (Drucker 1997) with a linear loss, from the sums that it needs."""

    rate: float
    votes: list[float] = field(default_factory=list)

    def after(self, worst: float, weighted: float, total: float) -> tuple[bool, bool, float]:
        """Whether the tree stays, whether another round follows, and the base of the rows' decay."""
        error = weighted / worst / total if worst else 0.0
        if error >= 0.5 and self.votes:
            return False, False, 1.0
        if error <= 0.0 or error >= 0.5:
            self.votes.append(1.0)
            return True, False, 1.0
        beta = error / (1.0 - error)
        self.votes.append(self.rate * float(np.log(1.0 / beta)))
        return True, True, beta


def ada_boost(block: Block, rules: Rules, rounds: int, rate: float, seed: int) -> tuple[list[Nodes], list[float]]:
    """Trees on weighted rows and their votes."""
    state, trees, w = AdaState(rate), [], np.ones(len(block.y))
    block = block.counted_together()
    block = replace(block, counts=block.histogram()[0])
    for number in range(rounds):
        nodes, leaf = grow(replace(block, w=w), rules, tree_key(seed, number))
        miss = np.abs(np.asarray(nodes.value)[leaf] - block.y)
        worst, total = float(miss.max()), float(w.sum())
        stays, goes_on, beta = state.after(worst, float((w * miss).sum()), total)
        if stays:
            trees.append(nodes)
        if not goes_on:
            break
        w = w * beta ** ((1.0 - miss / worst) * rate) / total
    return trees, state.votes

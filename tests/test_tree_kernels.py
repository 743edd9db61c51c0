"""What the tree kernels go over, and that short ways give the trees of long ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavelstat.operators import tree_cells as C
from gavelstat.operators import tree_growth as T


def _block(n=4000, weighted=False, seed=1):
    rng = np.random.default_rng(seed)
    widths = [2, 40, 300, 5]
    x = np.stack([rng.integers(0, w, n) for w in widths]).astype(np.uint16)
    y = np.sin(x[1] / 7) + (x[2] > 120) * x[0] + rng.normal(0, 0.1, n)
    values = np.stack([np.pad(np.cumsum(rng.random(w)), (0, 300 - w), mode="edge") for w in widths])
    return C.Block(x, y, widths, values, rng.integers(1, 4, n).astype(float) if weighted else None)


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("depth", [0, 1, 4, 7])
def test_larger_children_are_not_counted(monkeypatch, weighted, depth):
    block, rules = _block(weighted=weighted), C.Rules(depth=depth, min_leaf=3)
    counted, plain = [], C.Block.histogram
    monkeypatch.setattr(C.Block, "histogram", lambda self, rows=None: (counted.append(len(self.y) if rows is None else len(rows)), plain(self, rows))[1])
    nodes, leaf = C.grow(block, rules, C.tree_key(1, 0))
    assert sum(counted) <= len(block.y) * (1 + max(depth - 1, 0) / 2)
    monkeypatch.setattr(C, "HELD_CELLS", 0)
    levels, leaf_of_levels = C.grow(block, rules, C.tree_key(1, 0))
    for a, b in zip(nodes.arrays(), levels.arrays()):
        assert np.allclose(a, b, atol=1e-12)
    assert np.array_equal(leaf, leaf_of_levels) and len(nodes.feature) > depth


def test_cells_are_as_many_as_the_bins_of_the_nodes_own_features(monkeypatch):
    """A node of a narrow feature took as many cells as the widest feature of its level."""
    block, seen, plain = _block(), [], C.cuts_of_cells
    monkeypatch.setattr(C, "cuts_of_cells", lambda node, bin_, *rest: (seen.append((node, bin_)), plain(node, bin_, *rest))[1])
    C.grow(block, C.Rules(depth=3, tried=2), C.tree_key(3, 0))
    widest = max(block.widths)
    assert all(len(node) < widest * (node.max() + 1) for node, _ in seen[2:] if node.max() > 2)


@pytest.mark.parametrize("weighted", [False, True])
def test_random_cuts_are_those_of_the_drawn_values(weighted):
    block = _block(600, weighted)
    slot = np.sort(np.random.default_rng(2).integers(0, 7, 600))
    rules, keys, rows = C.Rules(min_leaf=4, random_cuts=True), C.mix(np.arange(7)), np.arange(600)
    found = C.search(block.x, rows, slot, block.y, block.w, keys, block.widths, rules, block.values)
    w = np.ones(600) if block.w is None else block.w
    for node in range(7):
        inside, best = slot == node, (-np.inf,)
        for f in range(4):
            bins, u = block.x[f][inside], float(C.uniform(keys[node : node + 1], f)[0])
            value = block.values[f][bins]
            low = value <= value.min() + u * (value.max() - value.min())
            if 4 <= low.sum() <= len(low) - 4:
                wy, ww = (w * block.y)[inside], w[inside]
                gain = wy[low].sum() ** 2 / ww[low].sum() + wy[~low].sum() ** 2 / ww[~low].sum() - wy.sum() ** 2 / ww.sum()
                if gain > best[0] + 1e-9:
                    best = (gain, f, bins[low].max(), (low.sum(), ww[low].sum(), wy[low].sum()))
        assert (found.feature[node], found.bin[node]) == best[1:3]
        assert np.allclose(found.left[node], best[3]) and np.isclose(found.gain[node], best[0])


def test_random_cuts_make_no_array_of_values_by_row(monkeypatch):
    """Values were looked up for all rows of every feature; now for the ends of each node alone."""
    block, asked = _block(3000), []

    class Values(np.ndarray):
        def __getitem__(self, at):
            found = super().__getitem__(at)
            asked.append(np.size(found) if isinstance(at, tuple) else 0)
            return found

        def take(self, indices, *rest, **named):
            asked.append(np.size(indices))
            return super().take(indices, *rest, **named)

    slot = np.repeat(np.arange(3), 1000)
    C.search(block.x, np.arange(3000), slot, block.y, None, C.mix(np.arange(3)), block.widths, C.Rules(random_cuts=True), block.values.view(Values))
    assert asked and max(asked) <= 3


def test_leaves_of_rows_of_any_layout():
    block = _block(2000)
    nodes, leaf = C.grow(block, C.Rules(depth=9), C.tree_key(5, 0))
    assert np.array_equal(C.leaves_of(nodes, block.x), leaf)
    assert np.array_equal(C.leaves_of(nodes, block.x[:, ::2]), leaf[::2])
    assert block.take(np.arange(0, 2000, 3)).x.flags["C_CONTIGUOUS"]


def test_features_of_few_bins_are_counted_together(monkeypatch):
    rng = np.random.default_rng(9)
    widths = [7, 3, C.JOINT_CELLS + 1, 2, 40, 11, 5]
    x = np.stack([rng.integers(0, w, 900) for w in widths]).astype(np.uint16)
    y, w, rows = rng.normal(size=900), rng.integers(0, 4, 900).astype(float), np.flatnonzero(rng.random(900) < 0.3)
    for block in (C.Block(x, y, widths), C.Block(x, y, widths, w=w)):
        for some in (None, rows):
            plain, together = block.histogram(some), block.counted_together().histogram(some)
            np.testing.assert_allclose(together, plain, atol=1e-9)
            part = slice(None) if some is None else some
            expected = np.bincount(x[4, part], (y if block.w is None else w * y)[part], 40)
            np.testing.assert_allclose(plain[2][block.offsets()[4] :][:40], expected, atol=1e-9)
    groups = C.joints(x, widths)
    assert sorted(f for g in groups for f in g.features) == list(range(len(widths)))
    assert all(np.prod(g.widths) <= C.JOINT_CELLS for g in groups if len(g.features) > 1)

    passes, count = [], np.bincount
    monkeypatch.setattr(C.np, "bincount", lambda *args, **options: passes.append(1) or count(*args, **options))
    list(C.boost(C.Block(x[[0, 1, 3, 6]], y, [7, 3, 2, 5]), np.arange(900, dtype=np.uint64), C.Rules(depth=3), 1, 0.1, 1.0, 1))
    # both of all rows once, their sums again in the round, both for the smaller side of three splits; no pass per feature
    assert len(passes) <= 2 + 1 + 3 * 2


def test_nodes_whose_targets_agree_stay_leaves():
    x = np.repeat(np.arange(4), 5)[None].astype(np.uint16)
    y = np.repeat([1.0, 1.0, 2.0, 2.0], 5)
    nodes, leaf = C.grow(C.Block(x, y, [4]), C.Rules(depth=4), C.tree_key(1, 0))
    assert np.asarray(nodes.feature).tolist() == [0, -1, -1] and np.asarray(nodes.cut)[0] == 1
    assert leaf.tolist() == [1] * 10 + [2] * 10


@pytest.mark.parametrize("plan", [
    T.ForestPlan(5, C.Rules(min_leaf=2, tried=2)),
    T.ForestPlan(3, C.Rules(depth=9, min_leaf=4, min_split=10, random_cuts=True)),
    T.ForestPlan(4, C.Rules(), share=0.5, draws=1.0),
    T.ForestPlan(3, C.Rules(depth=4, tried=3, random_cuts=True), draws=0.7),
])
def test_jobs_of_the_jvm_grow_the_trees_of_the_numpy_kernels(spark, monkeypatch, plan):
    """Units grew in Python, an operation of numpy at a time."""
    monkeypatch.setattr(T, "in_units", None)
    rng, names = np.random.default_rng(4), ["a", "b", "c", "d"]
    x = np.stack([rng.integers(0, w, 3000) for w in (2, 40, 700, 5)]).astype(float)
    y = np.sin(x[1] / 7) + (x[2] > 120) * x[0] + rng.normal(0, 0.1, 3000)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(np.column_stack([x.T, y]))], "k int, a double, b double, c double, d double, y double")
    bins = T.find_bins(df, names)
    rows = T.binned(df.repartition(3), bins, "y", F.col("k").cast("string"))
    forest = T.fit_forest(rows, bins, plan)
    h, y, x = T._arrays(rows.select("h", "y", "x").toArrow().combine_chunks().to_batches()[0])
    order, mean = np.lexsort((y, h)), float(y.mean())
    for number, tree in enumerate(forest.trees):
        block = T._block(x[:, order], y[order], mean, bins, plan, number, h[order])
        nodes, _ = C.grow(block, plan.rules, C.tree_key(plan.seed, number))
        want = bins.tree(*T._named(nodes, plan.allowed(number, 4), mean).arrays())
        for name in ("feature", "threshold", "left", "right"):
            np.testing.assert_array_equal(getattr(tree, name), getattr(want, name))
        np.testing.assert_allclose(tree.value, want.value, atol=1e-9)
        np.testing.assert_allclose(tree.cover, want.cover)


@pytest.mark.parametrize("rules,share", [(C.Rules(depth=4, min_leaf=4), 1.0), (C.Rules(leaves=9, strict=True), 1.0), (C.Rules(depth=5, tried=2), 0.7)])
def test_rounds_over_kept_blocks_are_those_of_one_task(spark, monkeypatch, rules, share):
    """Every pass counted cells in Python and dealt them out to be added up."""
    rng, names = np.random.default_rng(5), ["a", "b", "c"]
    x = np.stack([rng.integers(0, w, 2000) for w in (3, 60, 400)]).astype(float)
    y = np.cos(x[1] / 9) * x[0] + (x[2] > 90) + rng.normal(0, 0.1, 2000)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(np.column_stack([x.T, y]))], "k int, a double, b double, c double, y double")
    bins = T.find_bins(df, names)
    rows, plan = T.binned(df.repartition(3), bins, "y", F.col("k").cast("string")), T.BoostPlan(7, rules, 0.3, share)
    one = T.fit_boosted(rows, bins, plan)
    for name, value in (("count_cells", None), ("BOOST_ROWS", 200), ("BLOCK_ROWS", 100), ("ROUND_CUT", 2), ("FEW_TASKS", 1)):
        monkeypatch.setattr(T, name, value)
    kept = T.fit_boosted(rows, bins, plan)
    assert len(kept.trees) == 8 and all(len(t.feature) > 3 for t in kept.trees[1:])
    np.testing.assert_allclose(kept.predict(x.T), one.predict(x.T), atol=1e-9)

"""Trees against plain loops, and grown in units against grown by aggregations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavelstat.operators import models as M
from gavelstat.operators import tree_cells as C
from gavelstat.operators import tree_growth as T
from gavelstat.workspace import materialize

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, k, 1500) for k in (9, 40, 3, 200)], axis=1).astype(float)
    y = 5 * (x[:, 0] > 4) * (x[:, 1] > 20) + x[:, 2] + np.sin(x[:, 3] / 20) + rng.normal(scale=0.3, size=1500)
    rows = [(f"k{i}", *map(float, x[i]), float(y[i])) for i in range(1500)]
    return materialize(spark.createDataFrame(rows, "k string, a double, b double, c double, d double, bail_amount double").repartition(6))


def arrays(df):
    pdf = df.toPandas()
    return pdf[FEATURES].to_numpy(), pdf["bail_amount"].to_numpy()


def best_cut(x, y, rows, min_leaf):
    """(gain, feature, low side, high side) of the best cut between two values, the first of equals."""
    best = None
    for f in range(x.shape[1]):
        for v in np.unique(x[rows, f])[:-1]:
            low, high = rows[x[rows, f] <= v], rows[x[rows, f] > v]
            if min(len(low), len(high)) < min_leaf:
                continue
            gain = len(low) * len(high) / len(rows) * (y[low].mean() - y[high].mean()) ** 2
            if best is None or gain > best[0] * (1 + 1e-9):
                best = (gain, f, low, high)
    return best


def plain_tree(x, y, rows, depth, min_leaf):
    """Leaf means by row, growing to a depth."""
    cut = best_cut(x, y, rows, min_leaf) if depth else None
    if cut is None:
        return {int(r): y[rows].mean() for r in rows}
    return plain_tree(x, y, cut[2], depth - 1, min_leaf) | plain_tree(x, y, cut[3], depth - 1, min_leaf)


def plain_best_first(x, y, rows, leaves, min_leaf):
    done = [(best_cut(x, y, rows, min_leaf), rows)]
    while len(done) < leaves:
        at = max((i for i, (c, _) in enumerate(done) if c is not None), key=lambda i: done[i][0][0], default=None)
        if at is None:
            break
        _, _, low, high = done.pop(at)[0]
        done += [(best_cut(x, y, part, min_leaf), part) for part in (low, high)]
    return {int(r): y[part].mean() for _, part in done for r in part}


def as_array(values):
    return np.asarray([values[i] for i in range(len(values))])


@pytest.fixture(params=["units", "aggregations"])
def way(request, monkeypatch):
    if request.param == "aggregations":
        monkeypatch.setattr(T, "UNIT_ROWS", 300)
        monkeypatch.setattr(T, "SLOTS_TOGETHER", 7)
    return request.param


def test_a_deep_tree_on_all_features(data, way):
    x, y = arrays(data)
    forest = M.train(data, FEATURES, "random_forest", params={"n_estimators": 1, "max_depth": 4, "max_features": None, "min_samples_leaf": 5}).forest
    np.testing.assert_allclose(forest.predict(x), as_array(plain_tree(x, y, np.arange(1500), 4, 5)), atol=1e-9)


def test_boosting_equals_a_plain_loop(data, way):
    x, y = arrays(data)
    score = np.full(1500, y.mean())
    for _ in range(4):
        score += 0.3 * as_array(plain_tree(x, y - score, np.arange(1500), 3, 10))
    params = {"n_estimators": 4, "learning_rate": 0.3, "max_depth": 3, "min_samples_leaf": 10}
    np.testing.assert_allclose(M.train(data, FEATURES, "gradient_boosting", params=params).forest.predict(x), score, atol=1e-8)


def test_best_first_boosting_equals_a_plain_loop(data, way):
    x, y = arrays(data)
    score = np.full(1500, y.mean())
    for _ in range(3):
        score += 0.1 * as_array(plain_best_first(x, y - score, np.arange(1500), 9, 20))
    model = M.train(data, FEATURES, "hist_gradient_boosting", params={"max_iter": 3, "min_samples_leaf": 20, "max_leaf_nodes": 9})
    np.testing.assert_allclose(model.forest.predict(x), score, atol=1e-8)
    sizes = [len(t.value) for t in model.forest.trees[1:]]
    assert sizes == [17] * 3
    depths = [len(np.unique(path_lengths(t))) for t in model.forest.trees[1:]]
    assert max(depths) > 2  # deep on one side


def path_lengths(tree):
    depth = np.zeros(len(tree.value), int)
    for n in np.flatnonzero(tree.feature >= 0):
        depth[[tree.left[n], tree.right[n]]] = depth[n] + 1
    return depth[tree.feature < 0]


def plain_ada(x, y, rounds, rate):
    w, trees, votes = np.ones(len(y)), [], []
    for _ in range(rounds):
        block = C.Block(np.stack([np.unique(c, return_inverse=True)[1] for c in x.T]).astype(np.uint16), y, [len(np.unique(c)) for c in x.T], w=w)
        nodes, leaf = C.grow(block, C.Rules(depth=3), C.tree_key(1, 1))
        guess = np.asarray(nodes.value)[leaf]
        miss = abs(guess - y)
        error = (w * miss / miss.max()).sum() / w.sum()
        if error >= 0.5:
            break
        trees.append(guess)
        beta = error / (1 - error)
        votes.append(rate * np.log(1 / beta))
        w = w * beta ** ((1 - miss / miss.max()) * rate) / w.sum()
    order = np.argsort(np.stack(trees), axis=0, kind="stable")
    reached = np.cumsum(np.asarray(votes)[order], axis=0)
    first = (reached >= 0.5 * reached[-1]).argmax(axis=0)
    return np.stack(trees)[order[first, np.arange(len(y))], np.arange(len(y))]


def test_ada_boost_equals_a_plain_loop(data, way):
    x, y = arrays(data)
    model = M.train(data, FEATURES, "ada_boost", params={"n_estimators": 4})
    np.testing.assert_allclose(model.forest.predict(x), plain_ada(x, y, 4, 1.0), atol=1e-8)


@pytest.mark.parametrize("model_type,params", [
    ("random_forest", {"n_estimators": 5, "max_features": "sqrt", "min_samples_leaf": 3}),
    ("random_forest", {"n_estimators": 3, "max_features": "log2", "bootstrap": True, "max_depth": 6}),
    ("bagging", {"n_estimators": 4, "max_samples": 0.7}),
    ("extra_trees", {"n_estimators": 3, "max_depth": 7}),
    ("gradient_boosting", {"n_estimators": 7, "subsample": 0.7, "max_features": "sqrt"}),
])
def test_both_ways_grow_the_same_trees(data, monkeypatch, model_type, params):
    def fit(df):
        return M.train(df, FEATURES, model_type, params=params, key=F.col("k")).forest

    units = fit(data)
    again = fit(data.repartition(3))
    monkeypatch.setattr(T, "UNIT_ROWS", 200)
    large = fit(data)
    x, _ = arrays(data)
    for a, b, c in zip(units.trees, again.trees, large.trees):
        np.testing.assert_array_equal(a.feature, b.feature)
        assert len(a.value) == len(c.value)
        np.testing.assert_allclose(a.value[a.leaf_of(x)], c.value[c.leaf_of(x)], atol=1e-8)
        assert c.cover[0] == pytest.approx(c.cover[c.feature < 0].sum())


def test_min_split_and_leaf_sizes(data):
    x, y = arrays(data)
    tree = M.train(data, FEATURES, "random_forest", params={"n_estimators": 1, "min_samples_split": 100, "min_samples_leaf": 7}).forest.trees[0]
    inner = tree.feature >= 0
    assert tree.cover[inner].min() >= 100 and tree.cover[~inner].min() >= 7
    leaf = tree.leaf_of(x)
    for n in np.unique(leaf):
        assert tree.cover[n] == (leaf == n).sum() and tree.value[n] == pytest.approx(y[leaf == n].mean())


def test_staged_scores_equal_separate_fits(data, monkeypatch):
    options = [{"n_estimators": n, "max_depth": d, "subsample": 0.7} for n in (2, 5, 9) for d in (1, 3)]
    key = F.col("k")
    best, scores = M.search(data, FEATURES, "gradient_boosting", options, key=key)
    part = F.pmod(M.row_hash(key, M.SEED), F.lit(1000)) < 800
    for option, score in scores:
        model = M.train(data.filter(part), FEATURES, "gradient_boosting", params=option, key=key)
        assert M.evaluate(model.predict(data.filter(~part))).first()["r2"] == pytest.approx(score, abs=1e-9)
    monkeypatch.setattr(T, "UNIT_ROWS", 200)
    assert [s for _, s in M.search(data, FEATURES, "gradient_boosting", options[:2], key=key)[1]] == pytest.approx([s for _, s in scores[:2]], abs=1e-9)
    assert best == max(scores, key=lambda s: s[1])[0]


def test_fewer_trees_of_a_forest_share_its_fit(data):
    options = [{"n_estimators": n, "max_depth": 4} for n in (1, 3)]
    _, scores = M.search(data, FEATURES, "random_forest", options, key=F.col("k"))
    _, alone = M.search(data, FEATURES, "random_forest", options[:1], key=F.col("k"))
    assert scores[0][1] == pytest.approx(alone[0][1])


def test_many_values_become_quantile_bins(spark):
    df = spark.createDataFrame([(float(i % 997) ** 2, 1.0) for i in range(4000)], "a double, b double")
    bins = T.find_bins(df, ["a", "b"], 16)
    x, _ = (df.toPandas()[c].to_numpy() for c in ("a", "b"))
    counts = np.bincount(bins.of(np.stack([x, x], axis=1))[0], minlength=16)
    assert bins.widths == [16, 1] and counts.min() > 150
    assert T.find_bins(df, ["a"], 5000).widths == [997]


def test_draws_follow_their_laws():
    u = C.uniform(C.tree_key(1, 2), np.arange(200_000))
    assert abs(u.mean() - 0.5) < 0.01 and abs(C.poisson(u, 0.7).mean() - 0.7) < 0.02
    order = C.feature_order(C.mix(np.arange(60_000)), 4, C.Rules(tried=2))
    assert np.abs(np.bincount(order[:, 0], minlength=4) / 60_000 - 0.25).max() < 0.01


def test_one_row_and_equal_targets(spark):
    one = spark.createDataFrame([(1.0, 5.0)], "a double, bail_amount double")
    same = spark.createDataFrame([(float(i), 5.0) for i in range(50)], "a double, bail_amount double")
    for df in (one, same):
        for model_type in ("random_forest", "gradient_boosting", "hist_gradient_boosting", "extra_trees"):
            params = {"n_estimators": 2} if model_type != "hist_gradient_boosting" else {"max_iter": 2}
            assert {r["prediction"] for r in M.train(df, ["a"], model_type, params=params).predict(df).collect()} == {5.0}


def test_options_that_ask_for_the_same_trees_share_a_fit(data, monkeypatch):
    """The root and the logarithm of 15 features are 3, and a table above UNIT_ROWS was binned for each fit again."""
    fits = M._shared_fits("gradient_boosting", [{**M.GOOD_PARAMS["gradient_boosting"], **o} for o in M.candidates("gradient_boosting")], 15)
    assert len(fits) == 36 and sorted(i for _, served in fits for i in served) == list(range(216))
    assert len(M._shared_fits("ridge", M.candidates("ridge"), 15)) == 3
    options = [{"n_estimators": n, "max_depth": 3, "subsample": 0.7, "max_features": m} for n in (2, 4) for m in ("sqrt", "log2")]
    _, scores = M.search(data, FEATURES, "gradient_boosting", options, key=F.col("k"))
    binned, plain = [], T.binned
    monkeypatch.setattr(T, "binned", lambda *a: (binned.append(a), plain(*a))[1])
    monkeypatch.setattr(T, "UNIT_ROWS", 200)
    _, again = M.search(data, FEATURES, "gradient_boosting", options, key=F.col("k"))
    assert [s for _, s in again] == pytest.approx([s for _, s in scores], abs=1e-9)
    assert len(binned) == 1 and len({s for _, s in scores}) == 2

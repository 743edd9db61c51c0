import itertools
import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gavelstat.functions.columns import row_hash
from gavelstat.operators import explain as E
from gavelstat.operators import forest as forest_module
from gavelstat.operators import models as M
from gavelstat.operators.forest import Forest, attributions, dependence_sums, partial_dependence
from gavelstat.workspace import materialize

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(600, 3)), 2)
    y = 3 * x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.1, size=600)
    rows = [(f"k{i}", *map(float, x[i]), float(y[i])) for i in range(600)]
    return materialize(spark.createDataFrame(rows, "k string, a double, b double, c double, bail_amount double"))


@pytest.fixture(scope="module")
def boosted(data):
    return M.train(data, FEATURES, "gradient_boosting", params={"n_estimators": 4, "max_depth": 3})


def expected_value(tree, x, known, node=0):
    """Prediction when only the ``known`` features are given."""
    if tree.feature[node] < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if tree.feature[node] in known:
        return expected_value(tree, x, known, left if x[tree.feature[node]] <= tree.threshold[node] else right)
    share = tree.cover[left] / tree.cover[node]
    return share * expected_value(tree, x, known, left) + (1 - share) * expected_value(tree, x, known, right)


def shapley(tree, x, p):
    phi = np.zeros(p)
    for i in range(p):
        others = [j for j in range(p) if j != i]
        for k in range(p):
            for known in itertools.combinations(others, k):
                weight = math.factorial(k) * math.factorial(p - k - 1) / math.factorial(p)
                phi[i] += weight * (expected_value(tree, x, {*known, i}) - expected_value(tree, x, set(known)))
    return phi


def test_attributions_equal_brute_force_shapley(data, boosted):
    x = data.select(*FEATURES).toPandas().to_numpy()[:25]
    for tree in boosted.as_forest().trees:
        got = attributions(tree, x)
        for i in range(len(x)):
            np.testing.assert_allclose(got[i], shapley(tree, x[i], 3), atol=1e-10)


def test_attributions_add_up_to_the_prediction(data, boosted):
    wide = E.shap_values(data, boosted.as_forest(), FEATURES, ["k"]).toPandas().set_index("k")
    predicted = boosted.predict(data).select("k", "prediction").toPandas().set_index("k")["prediction"]
    total = wide[FEATURES].sum(axis=1) + wide["base_value"]
    np.testing.assert_allclose(total.loc[predicted.index], predicted, atol=1e-9)


def test_large_forests_are_applied_in_parts(data, boosted, monkeypatch):
    forest = boosted.as_forest()
    whole = E.shap_values(data, forest, FEATURES, ["k"]).toPandas().set_index("k")
    assert len(forest.groups(20)) > 1
    monkeypatch.setattr(Forest, "groups", lambda self, nodes=20: _parts(self, nodes))
    split = E.shap_values(data, forest, FEATURES, ["k"]).toPandas().set_index("k")
    np.testing.assert_allclose(split.loc[whole.index], whole, atol=1e-12)


def _parts(forest, nodes):
    return [Forest([t], [w], forest.combine) for t, w in zip(forest.trees, forest.weights)]


def test_median_forests_have_no_attributions(data):
    fitted = M.train(data, FEATURES, "ada_boost", params={"n_estimators": 2})
    with pytest.raises(ValueError, match="add up"):
        E.shap_values(data, fitted.forest, FEATURES, ["k"])


def test_summary(data, boosted):
    wide = E.shap_values(data, boosted.as_forest(), FEATURES, ["k"])
    long = E.melt_attributions(wide, FEATURES, ["k"])
    assert long.count() == 1800
    got = {r["feature"]: r["mean_abs_value"] for r in E.shap_summary(long).collect()}
    pdf = wide.toPandas()
    for f in FEATURES:
        assert got[f] == pytest.approx(pdf[f].abs().mean())


def test_dependence_by_training_proportions(data, boosted):
    """Against the definition: unknown features are averaged by the tree's own proportions."""
    grid = np.linspace(-1, 1, 7)
    for tree in boosted.as_forest().trees:
        for feature in range(3):
            got = partial_dependence(tree, feature, grid)
            for g, v in zip(grid, got):
                x = np.zeros(3)
                x[feature] = g
                assert v == pytest.approx(expected_value(tree, x, {feature}))


def test_dependence_of_all_kinds(data, boosted):
    forest = E.dependence(boosted, data).toPandas()
    assert set(forest["feature"]) == set(FEATURES)
    bagged = M.train(data, FEATURES, "bagging", params={"n_estimators": 3, "max_depth": 4}, key=F.col("k"))
    got = E.dependence(bagged, data, ["a"], resolution=10).toPandas()
    x = data.select(*FEATURES).toPandas().to_numpy()
    for _, row in got.iterrows():
        changed = x.copy()
        changed[:, 0] = row["values"]
        assert row["average"] == pytest.approx(bagged.forest.predict(changed).mean())
    line = M.train(data, FEATURES, "ridge")
    weights, intercept = line.linear()
    got = E.dependence(line, data, ["b"], resolution=5).toPandas()
    for _, row in got.iterrows():
        changed = x.copy()
        changed[:, 1] = row["values"]
        assert row["average"] == pytest.approx((intercept + changed @ np.array(weights)).mean())


def test_grids(spark):
    rows = [(float(i), float(i % 7)) for i in range(1000)]
    grids = E.feature_grids(spark.createDataFrame(rows, "many double, few double"), ["many", "few"])
    assert grids["few"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert len(grids["many"]) == 100
    # plotting position n p + 0.4 + 0.2 p, one-based
    assert grids["many"][0] == pytest.approx(1000 * 0.05 + 0.4 + 0.01 - 1)
    assert grids["many"][-1] == pytest.approx(1000 * 0.95 + 0.4 + 0.19 - 1)


def test_shuffling_is_a_permutation(data):
    seen = {}
    for rows, parts in ((10_000, 3), (100, 3), (100, 11)):
        moved = E.permuted(data.repartition(parts), FEATURES, F.col("k"), 1, rows).collect()
        donors = [tuple(r["__donor"]) for r in moved]
        own = [tuple(r[f] for f in FEATURES) for r in moved]
        assert sorted(donors) == sorted(own) and len(own) == 600
        assert sum(d == x for d, x in zip(donors, own)) < 10
        seen[rows, parts] = sorted((r["k"], tuple(r["__donor"])) for r in moved)
    # neither the number of ranges nor the partitioning decides who gives to whom
    assert len(set(map(str, seen.values()))) == 1


def test_donors_come_from_the_whole_table(spark):
    """Above one range, a row's donor lies in its own range no more often than chance has it."""
    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("a"))
    moved = E.permuted(df, ["a"], F.col("k"), 5, bucket_rows=1000)
    number = lambda c: F.call_function("shiftright", row_hash(c, 5), F.lit(30)) * 20 / 2**30
    same = number(F.col("k")).cast("int") == number(F.col("__donor.a").cast("bigint").cast("string")).cast("int")
    found = moved.agg(F.count("*").alias("n"), F.countDistinct("__donor.a").alias("d"), F.avg(same.cast("int")).alias("s")).first()
    assert (found.n, found.d) == (20_000, 20_000) and 0.03 < found.s < 0.07


def test_permuting_odd_tables(spark):
    empty = spark.createDataFrame([], "k string, a double")
    assert E.permuted(empty, ["a"], F.col("k"), 1).count() == 0
    twice = spark.createDataFrame([("x", 1.0)] * 5 + [(None, None)] * 3 + [("y", 2.0)], "k string, a double")
    moved = E.permuted(twice, ["a"], F.col("k"), 1, bucket_rows=2).collect()
    assert sorted(str(r["__donor"].a) for r in moved) == sorted(str(r.a) for r in moved) and len(moved) == 9


def test_dependence_by_sweep_equals_scoring_all_rows(data):
    """Summed and median forests, grid values on thresholds, missing values, features that no tree uses."""
    x = data.select(*FEATURES).toPandas().to_numpy()
    x = np.column_stack([x, np.zeros(len(x))])
    x[3, 1] = np.nan
    for kind, params in (("bagging", {"n_estimators": 7}), ("ada_boost", {"n_estimators": 9})):
        forest = M.train(data, FEATURES, kind, params=params, key=F.col("k")).forest
        cuts = np.concatenate([t.threshold[t.feature == 0] for t in forest.trees])
        for feature in range(4):
            grid = np.unique(np.concatenate([np.linspace(-3, 3, 17), cuts[:9]]))
            for cells in (64, 1 << 22):
                got = dependence_sums(forest, x, feature, grid, cells)
                for g, s in zip(grid, got):
                    changed = x.copy()
                    changed[:, feature] = g
                    assert s == pytest.approx(forest.predict(changed).sum())
    parts = E.sweep_dependence(data.repartition(5), forest, FEATURES, {"b": [-1.0, 0.5]}).collect()
    for row in parts:
        changed = x[:, :3].copy()
        changed[3, 1] = 0.0
        changed[:, 1] = row["values"]
        assert row["average"] == pytest.approx(forest.predict(changed).mean())
    assert E.sweep_dependence(data.limit(0), forest, FEATURES, {"b": [0.0]}).count() == 0


def test_permutation_importance_finds_the_strong_feature(data):
    fitted = M.train(data, FEATURES, "bagging", params={"n_estimators": 4, "max_depth": 6, "max_features": 1.0}, key=F.col("k"))
    found = {r["Feature"]: r["Importance"] for r in E.permutation_importance(fitted.predict, data, FEATURES, F.col("k")).collect()}
    assert max(found, key=found.get) == "a" and set(found) == set(FEATURES)


def test_association_profile(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        g = "FM"[i % 2]
        rows.append((f"c{i % 4 // 2}", f"j{i % 8}", g, "same", int(rng.integers(0, 9)), float(10 * (i % 2) + rng.normal())))
    df = spark.createDataFrame(rows, "county_name string, judge_name string, gender string, flat string, age int, bail_amount double")
    got = E.association_profile(df, ["age"], ["gender", "flat"]).toPandas()
    state = got[got["level"] == "state"].set_index("Feature")["Importance"]
    pdf = df.toPandas()
    eta = pdf.groupby("gender")["bail_amount"].transform("mean").var() / pdf["bail_amount"].var()
    r2 = np.corrcoef(pdf["age"], pdf["bail_amount"])[0, 1] ** 2
    assert state["gender"] == pytest.approx(eta / (eta + r2)) and state["flat"] == 0.0
    sums = got.groupby(["level", "county_name", "judge_name"], dropna=False)["Importance"].sum()
    np.testing.assert_allclose(sums, 1.0)
    assert len(sums) == 1 + 2 + 8


def test_rows_on_the_same_sides_of_all_splits_share_their_attributions(boosted, monkeypatch):
    x = np.random.default_rng(6).normal(size=(5_000, 3))
    for tree in boosted.as_forest().trees[1:]:
        looked_at = []
        by_row = forest_module._attributions
        monkeypatch.setattr(forest_module, "_attributions", lambda t, rows: looked_at.append(len(rows)) or by_row(t, rows))
        np.testing.assert_array_equal(attributions(tree, x), by_row(tree, x))
        monkeypatch.undo()
        assert sum(looked_at) <= 1 << (tree.feature >= 0).sum()


def test_leaves_of_a_tree_are_looked_up_once_for_many_batches(boosted, monkeypatch):
    forest, calls, leaves = boosted.as_forest(), [], forest_module.leaves
    monkeypatch.setattr(forest_module, "leaves", lambda tree: calls.append(1) or leaves(tree))
    x = np.random.default_rng(7).normal(size=(600, 3))
    wide = pd.DataFrame(x, columns=FEATURES).assign(k=[f"k{i}" for i in range(600)], **{f"__phi_{f}": 0.0 for f in FEATURES})
    kernel = E._attribution_kernel(SimpleNamespace(value=forest), FEATURES)
    found = pd.concat(kernel(iter([wide.iloc[i : i + 100] for i in range(0, 600, 100)])))
    assert len(calls) == len(forest.trees) and list(found.columns) == list(wide.columns) and found["k"].tolist() == wide["k"].tolist()
    expected = sum(w * attributions(t, x) for t, w in zip(forest.trees, forest.weights))
    np.testing.assert_allclose(found[[f"__phi_{f}" for f in FEATURES]].to_numpy(), expected, atol=1e-12)

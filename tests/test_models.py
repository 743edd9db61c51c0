import numpy as np
import pytest
from pyspark.sql import functions as F

from gavelstat.operators import grouped as G
from gavelstat.operators import models as M
from gavelstat.workspace import materialize, new_path

FEATURES = ["a", "b", "c"]
SMALL = {
    "gradient_boosting": {"n_estimators": 15},
    "random_forest": {"n_estimators": 10, "max_depth": 8},
    "hist_gradient_boosting": {"max_iter": 15, "min_samples_leaf": 5},
    "ada_boost": {"n_estimators": 8},
    "bagging": {"n_estimators": 10, "max_depth": 8, "max_features": 0.7},
    "extra_trees": {"n_estimators": 10, "max_depth": 8},
    "lasso": {"alpha": 0.01},
    "ridge": {"alpha": 0.1},
}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 3))
    y = 2 * x[:, 0] + np.where(x[:, 1] > 0.3, 1.5, -1.0) + rng.normal(scale=0.2, size=1200)
    rows = [(f"k{i}", *map(float, x[i]), float(y[i]), "hot" if i % 3 else f"g{i % 5}") for i in range(1200)]
    return materialize(spark.createDataFrame(rows, "k string, a double, b double, c double, bail_amount double, judge string"))


def arrays(df):
    pdf = df.toPandas()
    return pdf[FEATURES].to_numpy(), pdf["bail_amount"].to_numpy()


@pytest.mark.parametrize("model_type", list(M.GOOD_PARAMS))
def test_every_type_learns_stores_and_reloads(spark, data, model_type):
    fitted = M.train(data, FEATURES, model_type, params=SMALL[model_type], key=F.col("k"))
    metrics = M.evaluate(fitted.predict(data)).first()
    assert metrics["n"] == 1200 and metrics["r2"] > 0.5
    values = fitted.importances()
    if values is not None:
        assert sum(values) == pytest.approx(1.0)
        profile = fitted.importance_profile(spark).collect()
        assert profile[0]["Feature"] == "a" and {r["Feature"] for r in profile} == set(FEATURES)
    else:
        with pytest.raises(ValueError, match="permutation"):
            fitted.importance_profile(spark)
    again = M.load_model(spark, fitted.save(spark, new_path(spark, "model")))
    assert again.model_type == model_type and again.params == fitted.params
    before = {r["k"]: r["prediction"] for r in fitted.predict(data).collect()}
    after = {r["k"]: r["prediction"] for r in again.predict(data).collect()}
    assert before == after


def test_unknown_type(data):
    with pytest.raises(ValueError, match="unknown model type"):
        M.train(data, FEATURES, "perceptron")
    with pytest.raises(ValueError, match="row key"):
        M.train(data, FEATURES, "bagging")


@pytest.mark.parametrize("alpha", [0.1, 50.0])
def test_ridge_closed_form(data, alpha):
    x, y = arrays(data)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    coefficients, intercept = M.train(data, FEATURES, "ridge", params={"alpha": alpha}).linear()
    np.testing.assert_allclose(coefficients, want, rtol=1e-8)
    assert intercept == pytest.approx(y.mean() - want @ x.mean(0))


def test_lasso_against_coordinate_descent(data):
    x, y = arrays(data)
    xc, yc, w = x - x.mean(0), y - y.mean(), np.zeros(3)
    for _ in range(500):
        for j in range(3):
            rest = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ rest / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - 0.1, 0) / (xc[:, j] @ xc[:, j] / len(y))
    coefficients, _ = M.train(data, FEATURES, "lasso").linear()
    np.testing.assert_allclose(coefficients, w, atol=1e-5)


def test_boosted_medians_against_a_plain_loop(data):
    forest = M.train(data, FEATURES, "ada_boost", params={"n_estimators": 4}).forest
    x, _ = arrays(data)
    each = np.stack([t.value[t.leaf_of(x)] for t in forest.trees], axis=1)
    weights = np.asarray(forest.weights)
    for i in range(0, 1200, 97):
        pairs = sorted(zip(each[i], weights))
        total, reached = weights.sum(), 0.0
        for value, w in pairs:
            reached += w
            if reached >= total / 2:
                break
        assert forest.predict(x[i : i + 1])[0] == value


def test_extra_trees_leaves_hold_their_rows(data):
    forest = M.train(data, FEATURES, "extra_trees", params={"n_estimators": 3, "max_depth": 5}).forest
    x, y = arrays(data)
    for tree in forest.trees:
        leaf = tree.leaf_of(x)
        for n in np.flatnonzero(tree.feature < 0):
            inside = leaf == n
            assert inside.sum() == tree.cover[n] >= 4
            assert tree.value[n] == pytest.approx(y[inside].mean())
    same = M.train(data.repartition(5), FEATURES, "extra_trees", params={"n_estimators": 3, "max_depth": 5}).forest
    assert [t.feature.tolist() for t in same.trees] == [t.feature.tolist() for t in forest.trees]


def test_search(data):
    best, scores = M.search(data, FEATURES, "ridge", [{"alpha": 0.01}, {"alpha": 100000.0}])
    assert best == {"alpha": 0.01} and len(scores) == 2
    best, scores = M.search(data, FEATURES, "extra_trees", [{"n_estimators": 2, "max_depth": 1}, {"n_estimators": 4, "max_depth": 6}])
    assert best["max_depth"] == 6
    sizes = {t: len(M.candidates(t)) for t in M.PARAM_GRIDS}
    assert sizes["ada_boost"] == 9 and sizes["hist_gradient_boosting"] == 36 and sizes["lasso"] == 3
    assert len(M.candidates("extra_trees", 5)) == 5 == len({str(c) for c in M.candidates("extra_trees", 5)})


def test_models_per_group_equal_direct_fits(data):
    got = {r["judge"]: r for r in G.train_per_group(data, ["judge"], FEATURES).collect()}
    pdf = data.toPandas()
    assert set(got) == set(pdf["judge"])
    for judge, part in pdf.groupby("judge"):
        x, y = part[FEATURES].to_numpy(), part["bail_amount"].to_numpy()
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + 0.1 * np.eye(3), xc.T @ yc)
        r = got[judge]
        np.testing.assert_allclose(r["coefficients"], w, rtol=1e-8)
        error = y - (r["intercept"] + x @ w)
        assert r["n"] == len(part)
        assert r["mse"] == pytest.approx((error**2).mean())
        assert r["r2"] == pytest.approx(1 - (error**2).mean() / y.var())
    long = G.coefficient_profile(G.train_per_group(data, ["judge"], FEATURES), ["judge"], FEATURES)
    assert long.count() == len(got) * 3


def test_small_groups_are_left_out(spark, data):
    few = data.limit(4).withColumn("judge", F.lit("rare")).unionByName(data)
    assert "rare" not in {r["judge"] for r in G.train_per_group(few, ["judge"], FEATURES).collect()}
    graded = G.grade(G.fit_state_model(few, FEATURES).predict(few), ["judge"])
    assert "rare" not in {r["judge"] for r in graded.collect()}


def test_grading(data):
    state = G.fit_state_model(data, FEATURES)
    graded = G.grade(state.predict(data), ["judge"], limit=2).toPandas()
    pdf = state.predict(data).toPandas()
    assert graded["judge"].tolist() == sorted(pdf["judge"].unique())[:2]
    mine = pdf[pdf["judge"] == graded["judge"][0]]
    error = mine["bail_amount"] - mine["prediction"]
    assert graded["average_difference"][0] == pytest.approx(error.mean())
    assert graded["mse"][0] == pytest.approx((error**2).mean())


def test_separate_models_for_listed_targets(data):
    small = {"n_estimators": 3, "max_depth": 3}
    models = dict(G.train_for_targets(data, "judge", ["hot", "g1"], FEATURES, "gradient_boosting", params=small))
    assert list(models) == ["hot", "g1"]
    rows = data.filter("judge = 'g1'")
    got = models["g1"].predict(rows).agg(F.avg("prediction") - F.avg("bail_amount"), F.count("*")).first()
    assert got[0] == pytest.approx(0.0, abs=1e-9) and got[1] == rows.count()


def test_unlimited_trees_split_until_their_leaves_are_small(spark):
    rows = spark.createDataFrame([(float(i), float(2**i)) for i in range(12)], "a double, bail_amount double")
    one = {"max_iter": 1, "min_samples_leaf": 1}
    unlimited = M.train(rows, ["a"], "hist_gradient_boosting", params=one).as_forest().trees[1]
    assert len(unlimited.value) == 23  # the chain that splits off one row at a time
    assert len(M.train(rows, ["a"], "hist_gradient_boosting", params=one | {"max_depth": 3}).as_forest().trees[1].value) == 11  # both sides of the root

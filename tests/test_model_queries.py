"""What the registered model queries train, without training it."""

import numpy as np
import pytest

from gavelstat.operators import models as M
from gavelstat.plans import model_queries as Q
from gavelstat.plans import registry
from gavelstat.plans.catalog import KEY, cohort_of
from gavelstat.schema import TARGET

from conftest import SF

ENSEMBLES = ("gradient_boosting", "random_forest", "hist_gradient_boosting", "ada_boost", "bagging", "extra_trees")
EXPLAINED = {"feature_importance": "random_forest", "partial_dependence_forest": "gradient_boosting",
             "shap_values": "gradient_boosting", "shap_summary": "gradient_boosting"}


class Reached(Exception):
    pass


@pytest.fixture
def split(spark, monkeypatch):
    monkeypatch.setattr(Q, "_split", lambda *_, **__: (None, None, ["a", "b"]))


@pytest.mark.parametrize("name, model_type", [*zip(ENSEMBLES, ENSEMBLES), *EXPLAINED.items()])
def test_queries_train_whole_ensembles(monkeypatch, split, name, model_type):
    def train(rows, features, trained, target=None, params=None, key=None):
        raise Reached(trained, M.GOOD_PARAMS[trained] | (params or {}))

    monkeypatch.setattr(Q.M, "train", train)
    with pytest.raises(Reached) as found:
        registry.queries()[name](None, None)
    assert found.value.args == (model_type, M.GOOD_PARAMS[model_type])


def test_a_run_of_many_models_has_the_library_parameters(monkeypatch):
    def run(*_, types, params=None):
        raise Reached(params or {})

    monkeypatch.setattr(Q, "run_training", run)
    monkeypatch.setattr(Q, "star_of", lambda *_: None)
    with pytest.raises(Reached) as found:
        Q.multi_model_run(None, None)
    assert found.value.args == ({},)


def test_the_grid_is_fitted_whole_and_as_listed(monkeypatch, split):
    fitted = {}

    def search(rows, features, model_type, options, key=None):
        fitted[model_type] = options
        return options[0], [(o, 0.0) for o in options]

    class Session:
        def createDataFrame(self, rows, ddl):
            return rows

    monkeypatch.setattr(Q.M, "search", search)
    assert len(Q.param_grid(Session(), None)) == 3 + 216
    assert fitted == {t: M.candidates(t) for t in ("ridge", "gradient_boosting")}


@pytest.fixture(scope="module")
def parts(spark):
    return Q._split(spark, SF)


def arrays(rows, features):
    pdf = rows.orderBy(KEY).toPandas()
    return pdf[KEY].tolist(), pdf[features].to_numpy(float), pdf[TARGET].to_numpy(float)


def closed_form(x, y, alpha):
    centred = x - x.mean(0)
    w = np.linalg.lstsq(centred.T @ centred + alpha * np.eye(x.shape[1]), centred.T @ (y - y.mean()), rcond=None)[0]
    return w, y.mean() - x.mean(0) @ w


def test_linear_queries_over_all_features(spark, monkeypatch, parts):
    monkeypatch.setattr(Q, "_split", lambda *_, **__: parts)
    features = parts[2]
    _, x, y = arrays(parts[0], features)
    found = {r["feature"]: r["coefficient"] for r in Q.train_all(spark, SF).collect()}
    assert len(features) == 15 and set(found) == {"intercept", *features}
    w, b = np.array([found[f] for f in features]), found["intercept"]
    miss = y - b - x @ w
    assert np.abs(np.column_stack([np.ones(len(y)), x]).T @ miss).max() < 1e-6 * len(y)  # the normal equations
    keys, tested, _ = arrays(parts[1], features)
    for run in (Q.predict_all, Q.model_store_all):
        scored = {r[KEY]: r["prediction"] for r in run(spark, SF).collect()}
        assert [scored[k] for k in keys] == pytest.approx((b + tested @ w).tolist()) and len(scored) == len(keys)
    importance = Q.permutation_importance_all(spark, SF).collect()
    assert {r["Feature"] for r in importance} == set(features)
    for row in Q.partial_dependence_all(spark, SF).collect():
        i = features.index(row["feature"])
        others = tested.mean(0) @ w - tested[:, i].mean() * w[i]
        assert row["average"] == pytest.approx(b + others + w[i] * row["values"], abs=1e-6)


@pytest.mark.parametrize("name, column", [("grade_judges_stored", "judge_name"), ("grade_counties_stored", "county_name")])
def test_grades_by_a_stored_model_on_held_out_rows(spark, parts, name, column):
    features = parts[2]
    _, x, y = arrays(parts[0], features)
    w, b = closed_form(x, y, 0.1)
    keys, tested, actual = arrays(parts[1], features)
    names = {r[0]: r[1] for r in cohort_of(spark, SF).select(KEY, column).collect()}
    groups = {}
    for k, p, a in zip(keys, b + tested @ w, actual):
        groups.setdefault(names[k], []).append((p, a))
    groups = {g: np.array(v) for g, v in groups.items() if len(v) > 5}
    found = {r[column]: r for r in registry.queries()[name](spark, SF).collect()}
    assert found.keys() == groups.keys()
    for g, v in groups.items():
        assert found[g]["n"] == len(v)
        assert found[g]["average_predicted"] == pytest.approx(v[:, 0].mean(), abs=1e-6)
        assert found[g]["average_difference"] == pytest.approx((v[:, 1] - v[:, 0]).mean(), abs=1e-6)
        assert found[g]["mse"] == pytest.approx(((v[:, 1] - v[:, 0]) ** 2).mean(), abs=1e-6)

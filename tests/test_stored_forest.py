"""Forests that stay a table against the same forests on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavelstat.operators import models as M
from gavelstat.operators import stored_forest as S
from gavelstat.operators import tree_growth as T
from gavelstat.workspace import materialize, new_path

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, k, 1200) for k in (9, 300, 40)], axis=1).astype(float)
    y = 5 * (x[:, 0] > 4) + np.sin(x[:, 1] / 20) + rng.normal(scale=0.3, size=1200)
    rows = [(f"k{i}", *map(float, x[i]), float(y[i])) for i in range(1200)]
    return materialize(spark.createDataFrame(rows, "k string, a double, b double, c double, bail_amount double").repartition(5))


@pytest.mark.parametrize("unit_rows", [1 << 20, 250])
@pytest.mark.parametrize("model_type", ["random_forest", "extra_trees", "bagging"])
def test_a_forest_too_large_for_the_driver_stays_a_table(spark, data, monkeypatch, model_type, unit_rows):
    params, key = {"n_estimators": 7}, F.col("k")
    here = M.train(data, FEATURES, model_type, params=params, key=key)
    monkeypatch.setattr(T, "UNIT_ROWS", unit_rows)
    for name, value in (("DRIVER_NODES", 50), ("PIECE_NODES", 16), ("ROWS_TOGETHER", 400), ("ROWS_AT_ONCE", 100)):
        monkeypatch.setattr(S, name, value)
    monkeypatch.setattr(T, "PIECE_NODES", 16)
    stored = M.train(data, FEATURES, model_type, params=params, key=key)
    assert isinstance(here.forest, S.Forest) and isinstance(stored.forest, S.StoredForest)
    again = M.load_model(spark, stored.save(spark, new_path(spark, "large")))
    expected = [r["prediction"] for r in here.predict(data).orderBy("k").collect()]
    for model in (stored, again):
        assert [r["prediction"] for r in model.predict(data).orderBy("k").collect()] == pytest.approx(expected)
    assert stored.forest.base_value() == pytest.approx(here.forest.base_value())
    if model_type != "bagging":
        assert stored.importances() == pytest.approx(here.importances())
    parts = list(stored.forest.groups(500))
    assert len(parts) > 1 and sum(len(t.feature) for p in parts for t in p.trees) == sum(len(t.feature) for t in here.forest.trees)


def test_trees_grown_together_are_the_trees_grown_alone():
    from gavelstat.operators import tree_cells as C

    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (5, 90)).astype(np.uint16)
    block = C.Block(x, rng.normal(size=90), [12] * 5, np.tile(np.arange(12.0), (5, 1)))
    for rules in (C.Rules(tried=2, min_leaf=2), C.Rules(depth=6, random_cuts=True)):
        keys = np.asarray([C.tree_key(3, t) for t in range(6)])
        arrays, sizes = C.grow_together(block, rules, keys)
        ends = np.cumsum(sizes)
        for key, end, size in zip(keys, ends, sizes):
            alone = C.grow(block, rules, key)[0].arrays()
            for a, b in zip(alone, arrays):
                np.testing.assert_allclose(a, b[end - size : end])


def test_chunks_of_a_groups_forest_add_up_to_the_whole(data, monkeypatch):
    from gavelstat.operators import grouped as G

    grouped = data.withColumn("g", F.when(F.col("a") < 2, "small").otherwise("large"))
    fits = F.pmod(F.crc32("k"), F.lit(4)) > 0

    def run():
        found = G.train_trees_per_group(grouped, "g", FEATURES, "random_forest", F.col("k"), {"n_estimators": 9}, fits=fits)
        return {r["g"]: r for r in found.collect()}

    whole = run()
    monkeypatch.setattr(G, "CHUNK_WORK", 1 << 10)
    parts = run()
    for g, r in whole.items():
        mine = grouped.filter(F.col("g") == g)
        model = M.train(mine.filter(fits), FEATURES, "random_forest", params={"n_estimators": 9}, key=F.col("k"))
        judged = M.evaluate(model.predict(mine.filter(~fits))).first()
        for found in (r, parts[g]):
            assert found["mse"] == pytest.approx(judged["mse"]) and found["n_test"] == judged["n"]
            assert found["importances"] == pytest.approx(model.importances())

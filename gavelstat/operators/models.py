"""Regression models by name: training, scoring, metrics and storage."""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstat.functions.columns import row_hash
from gavelstat.operators import tree_growth as T
from gavelstat.operators.forest import Forest, Tree
from gavelstat.operators.stored_forest import StoredForest
from gavelstat.operators.tree_cells import Rules
from gavelstat.schema import TARGET
from gavelstat.workspace import release

# ---- fixed values: parameters of each model type ----
GOOD_PARAMS = {
    "gradient_boosting": {"learning_rate": 0.2, "max_depth": 4, "min_samples_leaf": 4, "n_estimators": 300},
    "random_forest": {
        "bootstrap": False,
        "max_depth": None,
        "max_features": "sqrt",
        "min_samples_leaf": 2,
        "n_estimators": 300,
    },
    "hist_gradient_boosting": {"max_iter": 300, "max_depth": None, "min_samples_leaf": 30},
    "ada_boost": {"n_estimators": 100, "learning_rate": 1.0},
    "bagging": {"n_estimators": 100, "max_samples": 1.0, "max_features": 0.5},
    "extra_trees": {"n_estimators": 300, "max_depth": 20, "min_samples_split": 10, "min_samples_leaf": 4},
    "lasso": {"alpha": 0.1},
    "ridge": {"alpha": 0.1},
}

# ---- fixed values: search grids ----
PARAM_GRIDS = {
    "gradient_boosting": {
        "n_estimators": [100, 200, 300],
        "learning_rate": [0.01, 0.1, 0.2],
        "max_depth": [3, 5, 7],
        "min_samples_leaf": [1, 4],
        "subsample": [0.7, 0.9],
        "max_features": ["sqrt", "log2"],
    },
    "random_forest": {
        "n_estimators": [100, 200, 300],
        "max_depth": [None, 10, 20],
        "min_samples_leaf": [1, 2],
        "max_features": ["sqrt", "log2"],
        "bootstrap": [True, False],
    },
    "hist_gradient_boosting": {
        "max_iter": [100, 200, 300],
        "max_depth": [None, 10, 20, 30],
        "min_samples_leaf": [10, 20, 30],
    },
    "ada_boost": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 1.0]},
    "bagging": {"n_estimators": [10, 50, 100], "max_samples": [0.5, 0.7, 1.0], "max_features": [0.5, 0.7, 1.0]},
    "extra_trees": {
        "n_estimators": [100, 200, 300],
        "max_depth": [None, 10, 20],
        "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4],
    },
    "lasso": {"alpha": [0.01, 0.1, 1.0]},
    "ridge": {"alpha": [0.01, 0.1, 1.0]},
}

DEFAULT_TYPES = ["random_forest", "gradient_boosting"]
SEED = 42
#: Parameters of each tree ensemble: the one that counts its trees, and the bins per feature.
ROUNDS = {"gradient_boosting": "n_estimators", "hist_gradient_boosting": "max_iter", "random_forest": "n_estimators",
          "ada_boost": "n_estimators", "bagging": "n_estimators", "extra_trees": "n_estimators"}
BOOSTED = ("gradient_boosting", "hist_gradient_boosting")
HIST_BINS, HIST_LEAVES = 255, 31
VECTOR = "__features"


@dataclass(frozen=True)
class FittedModel:
    """A trained model with the feature order it expects.

    ``model`` is an MLlib pipeline of a linear model; ensembles of trees are a ``forest`` instead.
    """

    model_type: str
    features: list[str]
    params: dict
    model: PipelineModel | None = None
    forest: Forest | StoredForest | None = None
    extra: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        """``df`` with a prediction column."""
        if self.model is not None:
            scored = self.model.transform(df).drop(VECTOR)
            return scored.withColumnRenamed("prediction", column)
        if isinstance(self.forest, StoredForest):
            return self.forest.predict(df, self.features, column)
        result = df
        parts = self.forest.groups()
        if self.forest.combine != "sum" or len(parts) == 1:
            return result.withColumn(column, _score(df.sparkSession, self.features, self.forest)(*self.features))
        total = F.lit(0.0)
        for part in parts:
            total = total + _score(df.sparkSession, self.features, part)(*self.features)
        return result.withColumn(column, total)

    def as_forest(self) -> Forest | StoredForest | None:
        """The trees, for models made of trees."""
        return self.forest

    def linear(self) -> tuple[list[float], float] | None:
        """Coefficients and intercept, for linear models."""
        stage = self.model.stages[-1] if self.model is not None else None
        if stage is None or not hasattr(stage, "coefficients"):
            return None
        return [float(w) for w in stage.coefficients.toArray()], float(stage.intercept)

    def importances(self) -> list[float] | None:
        """Share of the impurity reduction per feature; None for linear and bagged models."""
        if isinstance(self.forest, StoredForest):
            return None if self.model_type == "bagging" else self.forest.shares(len(self.features), _gains).tolist()
        return None if self.forest is None else forest_shares(self.forest, self.model_type, len(self.features))

    def importance_profile(self, spark: SparkSession) -> DataFrame:
        """(Feature, Importance), one row per feature, most important first."""
        values = self.importances()
        if values is None:
            raise ValueError(f"{self.model_type} has no built-in importances; use permutation importance")
        rows = sorted(zip(self.features, values), key=lambda r: (-r[1], r[0]))
        return spark.createDataFrame([(f, float(v)) for f, v in rows], "Feature string, Importance double")

    def save(self, spark: SparkSession, path: str) -> str:
        """Store type, parameters and the fitted model under ``path``."""
        meta = {"model_type": self.model_type, "features": self.features, "params": self.params,
                "combine": self.forest.combine if self.forest else None}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/pipeline")
        else:
            forest_table(spark, self.forest).write.mode("overwrite").parquet(f"{path}/forest")
        return path


def load_model(spark: SparkSession, path: str) -> FittedModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    common = (meta["model_type"], meta["features"], meta["params"])
    if meta["combine"] is None:
        return FittedModel(*common, model=PipelineModel.load(f"{path}/pipeline"))
    return FittedModel(*common, forest=forest_from_table(spark.read.parquet(f"{path}/forest"), meta["combine"]))


def forest_table(spark: SparkSession, forest: Forest | StoredForest) -> DataFrame:
    """One row per tree with its nodes as arrays; a forest larger than the driver as the pieces that it consists of."""
    if isinstance(forest, StoredForest):
        return forest.table.withColumn("weight", F.lit(1.0 / forest.count))
    names = ("feature", "threshold", "left", "right", "value", "cover")
    kinds = (pa.int16(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
    columns = {"tree": pa.array(range(len(forest.trees)), pa.int32()), "weight": pa.array(forest.weights, pa.float64())}
    for name, kind in zip(names, kinds):
        columns[name] = pa.array([getattr(t, name) for t in forest.trees], pa.list_(kind))
    return spark.createDataFrame(pa.table(columns))


def forest_from_table(table: DataFrame, combine: str) -> Forest | StoredForest:
    if "start" in table.columns:
        return StoredForest(table.drop("weight"), table.agg(F.max("tree")).first()[0] + 1, combine)
    stored = table.orderBy("tree").toArrow()
    names = ("feature", "threshold", "left", "right", "value", "cover")
    columns = [stored.column(c) for c in names]
    trees = [Tree(*[c[i].values.to_numpy() for c in columns]) for i in range(stored.num_rows)]
    return Forest(trees, stored.column("weight").to_pylist(), combine)


def _score(spark: SparkSession, features: Sequence[str], forest: Forest):
    """Vectorised scorer; the forest is sent to the tasks once as a broadcast variable."""
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        return pd.Series(shared.value.predict(x))

    return score


def forest_shares(forest: Forest, model_type: str, p: int) -> list[float] | None:
    """Importances of ``p`` features; None for bagged trees, which are not asked for them."""
    return None if model_type == "bagging" else _forest_importances(forest, p, model_type not in BOOSTED).tolist()


def _forest_importances(forest: Forest, p: int, per_tree: bool) -> np.ndarray:
    """Reduction of squared error by feature, in shares: of each tree, then averaged, or of all trees together."""
    total = np.zeros(p)
    for tree, weight in zip(forest.trees, forest.weights):
        found = _gains(tree, p)
        if found.sum() > 0:
            total += weight * (found / found.sum() if per_tree else found)
    return total / total.sum() if total.sum() else total


def _gains(tree: Tree, p: int) -> np.ndarray:
    """What the splits on each feature take off the squared error."""
    n = np.flatnonzero(tree.feature >= 0)
    gain = np.zeros(len(n))
    for side in (tree.left[n], tree.right[n]):
        gain += tree.cover[side] * (tree.value[side] - tree.value[n]) ** 2
    return np.bincount(tree.feature[n], gain, p)


def summed_shares(tree: Tree, roots: np.ndarray, p: int) -> np.ndarray:
    """Each tree's shares of the gains by feature, added up over trees that share node arrays and begin at ``roots``."""
    n = np.flatnonzero(tree.feature >= 0)
    gain = sum(tree.cover[side] * (tree.value[side] - tree.value[n]) ** 2 for side in (tree.left[n], tree.right[n]))
    place = (np.searchsorted(roots, n, side="right") - 1) * p + tree.feature[n]
    gains = np.bincount(place, gain, len(roots) * p).reshape(len(roots), p)
    whole = gains.sum(axis=1, keepdims=True)
    return np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0).sum(axis=0)


# ---- estimators ----


def tried_features(value, p: int) -> int | None:
    """How many features a node draws: all, a share of them, or their square root or logarithm."""
    if value in (None, 1.0):
        return None
    count = {"sqrt": p**0.5, "log2": np.log2(p)}.get(value) if isinstance(value, str) else value * p
    return max(1, int(count))


def rules_of(model_type: str, p: dict, features: int) -> Rules:
    """How the trees of an ensemble grow, from parameters in their usual names."""
    common = {"min_leaf": p.get("min_samples_leaf", 1), "min_split": p.get("min_samples_split", 2)}
    if model_type == "ada_boost":
        return Rules(depth=p.get("max_depth", 3))
    if model_type == "bagging":
        return Rules(depth=p.get("max_depth"), **common)
    if model_type == "hist_gradient_boosting":
        return Rules(depth=p["max_depth"], leaves=p.get("max_leaf_nodes", HIST_LEAVES), strict=True, **common)
    return Rules(depth=p["max_depth"], tried=tried_features(p.get("max_features"), features),
                 random_cuts=model_type == "extra_trees", **common)


def plan_of(model_type: str, p: dict, features: int) -> T.ForestPlan | T.BoostPlan | T.AdaPlan:
    """What a tree ensemble's parameters ask for."""
    rules, seed, count = rules_of(model_type, p, features), p.get("seed", SEED), p[ROUNDS[model_type]]
    if model_type in BOOSTED:
        return T.BoostPlan(count, rules, p.get("learning_rate", 0.1), p.get("subsample", 1.0), seed)
    if model_type == "ada_boost":
        return T.AdaPlan(count, rules, p["learning_rate"], seed)
    if model_type == "bagging":
        return T.ForestPlan(count, rules, p["max_features"], p["max_samples"], seed)
    return T.ForestPlan(count, rules, 1.0, 1.0 if p.get("bootstrap") else None, seed)


def _fit_trees(rows: DataFrame, bins: T.Bins, plan: T.ForestPlan | T.BoostPlan | T.AdaPlan) -> Forest:
    if isinstance(plan, T.BoostPlan):
        return T.fit_boosted(rows, bins, plan)
    return T.fit_ada(rows, bins, plan) if isinstance(plan, T.AdaPlan) else T.fit_forest(rows, bins, plan)


def find_bins(df: DataFrame, features: Sequence[str], model_type: str) -> T.Bins:
    return T.find_bins(df, features, HIST_BINS if model_type == "hist_gradient_boosting" else T.MOST_VALUES)


def estimator(model_type: str, target: str = TARGET, params: dict | None = None, scale: tuple[float, int] | None = None):
    """The MLlib estimator of a linear model type with parameters in their usual names."""
    p = {**GOOD_PARAMS[model_type], **(params or {})}
    common = {"featuresCol": VECTOR, "labelCol": target}
    if model_type == "lasso":
        return LinearRegression(
            elasticNetParam=1.0, regParam=p["alpha"], standardization=False, maxIter=1000, tol=1e-10, **common
        )
    if model_type == "ridge":
        # the penalty is per row and in units of the label's deviation
        deviation, n = scale or (1.0, 1)
        return LinearRegression(
            elasticNetParam=0.0, regParam=p["alpha"] * deviation / n, standardization=False, solver="normal", **common
        )
    raise ValueError(f"{model_type} has no MLlib estimator")


def train(
    df: DataFrame,
    features: Sequence[str],
    model_type: str,
    target: str = TARGET,
    params: dict | None = None,
    key: Column | None = None,
) -> FittedModel:
    """Fit one model on a stored table of numeric features.

    ``key`` identifies rows, whose draws follow from it; bagging insists on it, others take the content of a row.
    """
    if model_type not in GOOD_PARAMS:
        raise ValueError(f"unknown model type {model_type!r}; known are {sorted(GOOD_PARAMS)}")
    features, merged = list(features), {**GOOD_PARAMS[model_type], **(params or {})}
    if model_type == "bagging" and key is None:
        raise ValueError("bagging needs the row key")
    if model_type in ROUNDS:
        bins = find_bins(df, features, model_type)
        rows = T.binned(df, bins, target, key)
        forest = _fit_trees(rows, bins, plan_of(model_type, merged, len(features)))
        release(rows)
        return FittedModel(model_type, features, merged, forest=forest)
    scale = None
    if model_type == "ridge":
        row = df.agg(F.stddev_pop(target), F.count(target)).first()
        scale = (row[0], row[1])
    assembler = VectorAssembler(inputCols=features, outputCol=VECTOR)
    pipeline = Pipeline(stages=[assembler, estimator(model_type, target, params, scale)])
    return FittedModel(model_type, features, merged, model=pipeline.fit(df.select(*features, target)))


def train_linear(df: DataFrame, features: Sequence[str], target: str = TARGET) -> FittedModel:
    """Ordinary least squares."""
    assembler = VectorAssembler(inputCols=list(features), outputCol=VECTOR)
    ols = LinearRegression(featuresCol=VECTOR, labelCol=target, regParam=0.0, solver="normal")
    return FittedModel("linear", list(features), {}, model=Pipeline(stages=[assembler, ols]).fit(df.select(*features, target)))


# ---- evaluation ----


def evaluate(
    scored: DataFrame, by: Sequence[str] = (), target: str = TARGET, prediction: str = "prediction"
) -> DataFrame:
    """Rows, mean squared error and R² of a scored table, in one pass.

    The spread around the mean comes from the population variance, so the mean need not be
    known beforehand.  R² is NULL where the target does not vary.
    """
    y, p = F.col(target), F.col(prediction)
    mse = F.avg((y - p) * (y - p))
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), mse.alias("mse"), (1 - F.try_divide(mse, F.var_pop(y))).alias("r2")
    )


def group_mean_predictor(train_rows: DataFrame, by: Sequence[str], target: str = TARGET) -> DataFrame:
    """The mean target per group, as a table to join on."""
    return train_rows.groupBy(*by).agg(F.avg(target).alias("prediction"))


def run_models(
    train_rows: DataFrame, test_rows: DataFrame, features: Sequence[str], types: Sequence[str] = tuple(DEFAULT_TYPES),
    params: dict[str, dict] | None = None, target: str = TARGET, key: Column | None = None,
) -> list[tuple[FittedModel, float, float]]:
    """Train every model type on one stored split; (model, mse, r2) each."""
    results = []
    for model_type in types:
        fitted = train(train_rows, features, model_type, target, (params or {}).get(model_type), key)
        row = evaluate(fitted.predict(test_rows), target=target).first()
        results.append((fitted, row["mse"], row["r2"]))
    return results


def candidates(model_type: str, limit: int | None = None, seed: int = SEED) -> list[dict]:
    """Parameter combinations of a grid; a seeded sample of ``limit`` of them if given."""
    grid = PARAM_GRIDS[model_type]
    every = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if limit is None or limit >= len(every):
        return every
    picked = np.random.default_rng(seed).choice(len(every), limit, replace=False)
    return [every[i] for i in sorted(picked)]


def search(
    df: DataFrame, features: Sequence[str], model_type: str, options: Sequence[dict], target: str = TARGET,
    parallelism: int = 2, train_ratio: float = 0.8, key: Column | None = None,
) -> tuple[dict, list[tuple[dict, float]]]:
    """Best parameters by R² on one hold-out; the fits run ``parallelism`` at a time.

    Which rows are held out follows from a hash of ``key`` (default: the row's content), so all model types are
    judged on the same rows, however the table is partitioned.  Options that differ in the number of trees alone, or
    not in what they ask for, share the fit with the most, whose first trees are the others' models.
    """
    if key is None:
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in [*features, target]])
    features = list(features)
    part = F.pmod(row_hash(key, SEED), F.lit(1000)) < F.lit(int(train_ratio * 1000))
    scores: list[float | None] = [None] * len(options)
    rows = binned_fit = None
    merged = [{**GOOD_PARAMS[model_type], **o} for o in options]
    fits = _shared_fits(model_type, merged, len(features))
    if model_type in BOOSTED:
        bins = find_bins(df.filter(part), features, model_type)
        rows = T.binned(df.withColumn("__fits", part), bins, target, key, ["__fits"])
        plans = [plan_of(model_type, p, len(features)) for p, _ in fits]
        if rows.count() <= T.UNIT_ROWS:
            found = T.staged_scores(rows, "__fits", bins, plans, [sorted(set(stages.values())) for _, stages in fits])
            for (_, stages), by_rounds in zip(fits, found):
                for i, rounds in stages.items():
                    scores[i] = by_rounds[rounds]
        else:
            learned = rows.filter("__fits").drop("__fits")

            def binned_fit(params: dict) -> Forest:
                return T.fit_boosted(learned, bins, plan_of(model_type, params, len(features)))

    if None in scores:
        fit_rows, test_rows = df.filter(part), df.filter(~part)

        def score(fit: tuple[dict, dict[int, int]]) -> None:
            if binned_fit is not None:
                fitted = FittedModel(model_type, features, fit[0], forest=binned_fit(fit[0]))
            else:
                fitted = train(fit_rows, features, model_type, target, fit[0], key=key)
            by_rounds: dict[int, float] = {}
            for i, rounds in fit[1].items():
                if rounds not in by_rounds:
                    shown = fitted if model_type not in ROUNDS else replace(fitted, forest=_first_trees(fitted, rounds))
                    by_rounds[rounds] = evaluate(shown.predict(test_rows), target=target).first()["r2"]
                scores[i] = by_rounds[rounds]

        with ThreadPool(parallelism) as pool:
            pool.map(inheritable_thread_target(df.sparkSession)(score), fits)
    if rows is not None:
        release(rows)
    return options[int(np.argmax(scores))], list(zip(options, scores))


def _shared_fits(model_type: str, merged: Sequence[dict], features: int) -> list[tuple[dict, dict[int, int]]]:
    """Parameters to fit, each with the options (by place) that it serves and their numbers of trees.  Options that ask for the
    same plan, as the root and the logarithm of 15 features do, are one fit too."""
    name, fits = ROUNDS.get(model_type), {}
    for i, p in enumerate(merged):
        rest = json.dumps(p, sort_keys=True) if name is None else plan_of(model_type, {**p, name: 1}, features)
        fits.setdefault(rest, {})[i] = p.get(name, 0)
    return [({**merged[max(s, key=s.get)]}, s) for s in fits.values()]


def _first_trees(model: FittedModel, rounds: int) -> Forest | StoredForest:
    forest = model.forest
    if isinstance(forest, StoredForest):
        return forest.first(rounds)
    kept = rounds + (model.model_type in BOOSTED)  # the constant that boosting starts from
    trees, weights = forest.trees[:kept], forest.weights[:kept]
    if model.model_type in BOOSTED or forest.combine != "sum":
        return replace(forest, trees=trees, weights=weights)
    return replace(forest, trees=trees, weights=[1.0 / len(trees)] * len(trees))

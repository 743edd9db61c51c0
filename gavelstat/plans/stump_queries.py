"""Tree learners on declared models of depth one, which SQL can follow split by split.

Three features with few values are all a stump here may use, so that every threshold between two values is tried.
The twins find the split, the leaves, the boosted updates, importances, attributions and dependences themselves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelstat.functions.columns import rounded
from gavelstat.operators import explain as E
from gavelstat.operators import models as M
from gavelstat.plans.catalog import KEY, WITH_PREPARED, query, r, split_ctes, star_of
from gavelstat.plans.training import prepared_split

FEW = ["top_charge_weight_at_arraign", "pend_misd", "pend_vfo"]
FEW_LIST = ", ".join(FEW)
STUMP = {
    "random_forest": {"n_estimators": 1, "max_depth": 1, "max_features": None, "min_samples_leaf": 1},
    "gradient_boosting": {"n_estimators": 2, "max_depth": 1, "min_samples_leaf": 1, "learning_rate": 0.2},
    "hist_gradient_boosting": {"max_iter": 2, "max_depth": 1, "min_samples_leaf": 1},
    "ada_boost": {"n_estimators": 2, "max_depth": 1, "learning_rate": 1.0},
}


def best_split(name: str, source: str, target: str, weight: str = "1.0") -> str:
    """SQL: the split of least squared error of ``target`` over ``source``, with both leaf means."""
    return f"""{name}_cells AS (SELECT f, v, sum(w) AS n, sum(w * t) AS s
  FROM (SELECT {target} AS t, CAST({weight} AS DOUBLE) AS w, {FEW_LIST} FROM {source}) UNPIVOT (v FOR f IN ({FEW_LIST})) GROUP BY f, v),
 {name}_sums AS (SELECT f, v, sum(n) OVER upto AS nl, sum(s) OVER upto AS sl, sum(n) OVER (PARTITION BY f) AS nt,
  sum(s) OVER (PARTITION BY f) AS st, lead(v) OVER (PARTITION BY f ORDER BY v) AS next_v
  FROM {name}_cells WINDOW upto AS (PARTITION BY f ORDER BY v)),
 {name} AS (SELECT f, v AS cut, sl / nl AS low, (st - sl) / (nt - nl) AS high, st / nt AS mean FROM {name}_sums
  WHERE next_v IS NOT NULL ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC, f, v LIMIT 1)"""


def leaf(split: str) -> str:
    """SQL: the leaf mean of a row."""
    value = " ".join(f"WHEN '{f}' THEN {f}" for f in FEW)
    return f"CASE WHEN CASE {split}.f {value} END <= {split}.cut THEN {split}.low ELSE {split}.high END"


TRAIN = f"""{WITH_PREPARED}{split_ctes('prepared')}, train AS (SELECT * FROM parts WHERE split = 'train'),
 test AS (SELECT * FROM parts WHERE split = 'test'), {best_split('one', 'train', 'bail_amount')}"""


def boosted(rate: float) -> str:
    first = f"one.mean + {rate} * ({leaf('one')} - one.mean)"
    residual = f"residual AS (SELECT train.*, bail_amount - ({first}) AS rest FROM train, one)"
    return f"""{TRAIN}, {residual}, {best_split('two', 'residual', 'rest')}
 SELECT internal_case_id, {r(f"{first} + {rate} * {leaf('two')}")} AS prediction FROM test, one, two"""


ADA_BOOST = f"""{TRAIN}, missed AS (SELECT train.*, abs(bail_amount - {leaf('one')}) AS miss FROM train, one),
 first_round AS (SELECT max(miss) AS worst, avg(miss) / max(miss) AS error FROM missed),
 weighed AS (SELECT missed.*, pow(error / (1 - error), 1 - miss / worst) AS w FROM missed, first_round),
 {best_split('two', 'weighed', 'bail_amount', 'w')},
 missed_two AS (SELECT w, abs(bail_amount - {leaf('two')}) AS miss FROM weighed, two),
 second_round AS (SELECT sum(w * miss) / max(miss) / sum(w) AS error FROM missed_two),
 votes AS (SELECT ln((1 - a.error) / a.error) AS w1, ln((1 - b.error) / b.error) AS w2 FROM first_round a, second_round b),
 scored AS (SELECT internal_case_id, {leaf('one')} AS p1, {leaf('two')} AS p2, w1, w2 FROM test, one, two, votes)
 SELECT internal_case_id, {r('CASE WHEN CASE WHEN p1 <= p2 THEN w1 ELSE w2 END >= 0.5 * (w1 + w2) THEN least(p1, p2) ELSE greatest(p1, p2) END')}
  AS prediction FROM scored"""


def _fitted(spark, sf_dir, model_type):
    _, rows, _ = prepared_split(star_of(spark, sf_dir), KEY)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    return M.train(train, FEW, model_type, params=STUMP[model_type], key=F.col(KEY)), test


def _predictions(model_type):
    def run(spark, sf_dir):
        model, test = _fitted(spark, sf_dir, model_type)
        return model.predict(test).select(KEY, rounded(F.col("prediction")).alias("prediction"))

    return run


query("stump_forest", f"{TRAIN} SELECT internal_case_id, {r(leaf('one'))} AS prediction FROM test, one")(_predictions("random_forest"))
query("stump_boosting", boosted(0.2))(_predictions("gradient_boosting"))
query("stump_hist_boosting", boosted(0.1))(_predictions("hist_gradient_boosting"))
query("stump_ada_boost", ADA_BOOST)(_predictions("ada_boost"))


@query(
    "stump_importance",
    f"{TRAIN} "
    + " UNION ALL ".join(f"SELECT '{f}' AS Feature, CASE WHEN f = '{f}' THEN 1.0 ELSE 0.0 END::DOUBLE AS Importance FROM one" for f in FEW),
)
def stump_importance(spark, sf_dir):
    model, _ = _fitted(spark, sf_dir, "random_forest")
    return model.importance_profile(spark)


ATTRIBUTIONS = ", ".join(f"{r(f'''CASE WHEN one.f = '{f}' THEN {leaf('one')} - mean ELSE 0 END''')} AS {f}" for f in FEW)


@query("stump_attributions", f"{TRAIN} SELECT internal_case_id, {r('mean')} AS base_value, {ATTRIBUTIONS} FROM test, one")
def stump_attributions(spark, sf_dir):
    model, test = _fitted(spark, sf_dir, "random_forest")
    found = E.shap_values(test, model.as_forest(), FEW, [KEY])
    return found.withColumns({c: rounded(F.col(c)) for c in ["base_value", *FEW]})


@query(
    "stump_attribution_summary",
    f"{TRAIN} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {r(f'''avg(CASE WHEN one.f = '{f}' THEN abs({leaf('one')} - mean) ELSE 0 END)''')} AS mean_abs_value FROM test, one"
        for f in FEW
    ),
)
def stump_attribution_summary(spark, sf_dir):
    model, test = _fitted(spark, sf_dir, "random_forest")
    wide = E.shap_values(test, model.as_forest(), FEW, [KEY])
    summary = E.shap_summary(E.melt_attributions(wide, FEW, [KEY]))
    return summary.withColumn("mean_abs_value", rounded(F.col("mean_abs_value")))


@query(
    "stump_dependence",
    f"{TRAIN} "
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, {r('v')} AS "values",
 {r(f"CASE WHEN one.f <> '{f}' THEN mean WHEN v <= cut THEN low ELSE high END")} AS average FROM (SELECT DISTINCT {f} AS v FROM test), one"""
        for f in FEW
    ),
)
def stump_dependence(spark, sf_dir):
    model, test = _fitted(spark, sf_dir, "random_forest")
    found = E.dependence(model, test)
    return found.withColumns({c: rounded(F.col(c)) for c in ("values", "average")})

"""Models, grouped models, grading and explanations.

Fits that have a closed form are checked against it in SQL.  Tree models have none, but
a least-squares tree predicts the mean of each leaf, so sums of such trees reproduce the
mean of the training target exactly; that is what their SQL twins check, on the same
prepared and split rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelstat.functions.columns import rounded, to_number
from gavelstat.operators import explain as E
from gavelstat.operators import grouped as G
from gavelstat.operators import models as M
from gavelstat.operators import prepare as P
from gavelstat.operators.results import top_features as largest
from gavelstat.plans.catalog import (
    CATEGORICAL,
    KEY,
    NUMERIC,
    WITH_CAPPED,
    WITH_PREPARED,
    cohort_of,
    number,
    query,
    r,
    split_ctes,
    star_of,
)
from gavelstat.plans.training import grade_stored, persist_run, prepared_split, run_training
from gavelstat.schema import TARGET
from gavelstat.workspace import materialize, new_path

WITH_PARTS = WITH_PREPARED + split_ctes("prepared")
PAIR = ["age_at_arrest", "prior_misd_cnt"]


def _split(spark, sf_dir, carry=()):
    _, rows, learned = prepared_split(star_of(spark, sf_dir), KEY, carry=carry)
    return rows.filter("split = 'train'"), rows.filter("split = 'test'"), learned.features


# ---- tree models ----


def _calibration(model_type):
    def run(spark, sf_dir):
        train_rows, _, features = _split(spark, sf_dir)
        fitted = M.train(train_rows, features, model_type, key=F.col(KEY))
        return fitted.predict(train_rows).agg(
            F.lit(model_type).alias("model_type"),
            F.count("*").alias("n_train"),
            rounded(F.avg(TARGET)).alias("average_actual"),
            rounded(F.avg("prediction")).alias("average_predicted"),
        ).select("model_type", "n_train", "average_actual", "average_predicted")

    return run


def _calibration_sql(model_type):
    return f"""{WITH_PARTS} SELECT '{model_type}' AS model_type, count(*) AS n_train,
 {r('avg(bail_amount)')} AS average_actual, {r('avg(bail_amount)')} AS average_predicted
 FROM parts WHERE split = 'train'"""


for _type in ("gradient_boosting", "random_forest", "hist_gradient_boosting", "extra_trees"):
    query(_type, _calibration_sql(_type))(_calibration(_type))


def _metrics(model_type):
    def run(spark, sf_dir):
        train_rows, test_rows, features = _split(spark, sf_dir)
        fitted = M.train(train_rows, features, model_type, key=F.col(KEY))
        return M.evaluate(fitted.predict(test_rows)).withColumn("model_type", F.lit(model_type))

    return run


for _type in ("ada_boost", "bagging"):
    query(_type)(_metrics(_type))


# ---- linear models ----

AMOUNT_ROWS = f"""{WITH_CAPPED}, amounts AS (SELECT coalesce(CAST(age_at_arrest AS DOUBLE),
 (SELECT median(age_at_arrest) FROM capped)) AS age_at_arrest, bail_amount FROM capped)"""


def _amounts(spark, sf_dir):
    """Raw amounts and ages of the capped cohort, ages filled."""
    capped = P.quantile_cap(P.coerce_target(materialize(cohort_of(spark, sf_dir), "cohort")))
    return materialize(P.impute_median(capped.select(KEY, "age_at_arrest", TARGET), ["age_at_arrest"]), "amounts")


@query(
    "lasso",
    f"""{AMOUNT_ROWS}, m AS (SELECT covar_pop(age_at_arrest, bail_amount) AS c, var_pop(age_at_arrest) AS v,
  avg(age_at_arrest) AS mx, avg(bail_amount) AS my FROM amounts),
 w AS (SELECT sign(c) * greatest(abs(c) - 0.1, 0) / v AS w, mx, my FROM m)
 SELECT {r('w', 3)} AS coefficient, {r('my - w * mx', 2)} AS intercept FROM w""",
)
def lasso(spark, sf_dir):
    fitted = M.train(_amounts(spark, sf_dir), ["age_at_arrest"], "lasso")
    (w,), b = fitted.linear()
    return _row(spark, [(w, b)], 3, 2)


def _row(spark, values, digits_w, digits_b):
    df = spark.createDataFrame(values, "coefficient double, intercept double")
    return df.select(
        rounded(F.col("coefficient"), digits_w).alias("coefficient"), rounded(F.col("intercept"), digits_b).alias("intercept")
    )


@query(
    "ridge",
    f"""{AMOUNT_ROWS}, m AS (SELECT count(*) AS n, covar_pop(age_at_arrest, bail_amount) AS c,
  var_pop(age_at_arrest) AS v, avg(age_at_arrest) AS mx, avg(bail_amount) AS my FROM amounts),
 w AS (SELECT n * c / (n * v + 0.1) AS w, mx, my FROM m)
 SELECT {r('w', 3)} AS coefficient, {r('my - w * mx', 2)} AS intercept FROM w""",
)
def ridge(spark, sf_dir):
    fitted = M.train(_amounts(spark, sf_dir), ["age_at_arrest"], "ridge")
    (w,), b = fitted.linear()
    return _row(spark, [(w, b)], 3, 2)


def pair_moments(source, by="", where=""):
    """SQL: counts, means and covariances of the feature pair and the target."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""moments AS (SELECT {keys}count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(y) AS vy,
  var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2
 FROM (SELECT *, age_at_arrest AS x1, prior_misd_cnt AS x2, bail_amount AS y FROM {source} {where}) {group})"""


def pair_solution(alpha, by="", having=""):
    """SQL: both coefficients by Cramer's rule."""
    keys = f"{by}, " if by else ""
    return f"""normal AS (SELECT *, n * s11 + {alpha} AS a11, n * s12 AS a12, n * s22 + {alpha} AS a22, n * c1 AS b1,
  n * c2 AS b2 FROM moments {having}),
 solved AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS w1,
  (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2 FROM normal),
 fitted AS (SELECT {keys}n, w1, w2, my - w1 * m1 - w2 * m2 AS w0, vy, m1, m2,
  vy - 2 * (w1 * c1 + w2 * c2) + w1 * w1 * s11 + 2 * w1 * w2 * s12 + w2 * w2 * s22 AS mse FROM solved)"""


ON_TRAIN = "WHERE split = 'train'"
TRAIN_FIT = f"{WITH_PARTS}, {pair_moments('parts', where=ON_TRAIN)}, {pair_solution(0)}"


@query(
    "train",
    f"""{TRAIN_FIT} SELECT 'intercept' AS feature, {r('w0')} AS coefficient FROM fitted
 UNION ALL SELECT 'age_at_arrest', {r('w1')} FROM fitted UNION ALL SELECT 'prior_misd_cnt', {r('w2')} FROM fitted""",
)
def train(spark, sf_dir):
    """Least squares on the training part."""
    train_rows, _, _ = _split(spark, sf_dir)
    weights, intercept = M.train_linear(train_rows, PAIR).linear()
    rows = [("intercept", intercept), *zip(PAIR, map(float, weights))]
    df = spark.createDataFrame(rows, "feature string, coefficient double")
    return df.withColumn("coefficient", rounded(F.col("coefficient")))


PREDICTED = f"""{TRAIN_FIT} SELECT internal_case_id, {r('w0 + w1 * age_at_arrest + w2 * prior_misd_cnt')} AS prediction
 FROM parts, fitted WHERE split = 'test'"""


@query("predict", PREDICTED)
def predict(spark, sf_dir):
    train_rows, test_rows, _ = _split(spark, sf_dir)
    scored = M.train_linear(train_rows, PAIR).predict(test_rows)
    return scored.select(KEY, rounded(F.col("prediction")).alias("prediction"))


@query("model_store", PREDICTED)
def model_store(spark, sf_dir):
    """Predictions of a model after it has been stored and loaded again."""
    train_rows, test_rows, _ = _split(spark, sf_dir)
    path = M.train_linear(train_rows, PAIR).save(spark, new_path(spark, "model"))
    return M.load_model(spark, path).predict(test_rows).select(KEY, rounded(F.col("prediction")).alias("prediction"))


@query(
    "evaluate",
    f"""{WITH_PARTS}, named AS (SELECT p.*, b.judge_name AS judge FROM parts p JOIN base b USING (internal_case_id)),
 means AS (SELECT judge, avg(bail_amount) AS prediction FROM named WHERE split = 'train' GROUP BY judge),
 scored AS (SELECT bail_amount AS y, prediction AS p FROM named JOIN means USING (judge) WHERE split = 'test')
 SELECT count(*) AS n, {r('avg((y - p) * (y - p))')} AS mse,
  {r('1 - avg((y - p) * (y - p)) / var_pop(y)')} AS r2 FROM scored""",
)
def evaluate(spark, sf_dir):
    """The mean per judge as predictor, judged on the test part."""
    train_rows, test_rows, _ = _split(spark, sf_dir, carry=["judge_name"])
    means = M.group_mean_predictor(train_rows, ["judge_name_label"])
    metrics = M.evaluate(test_rows.join(means, "judge_name_label"))
    return metrics.select("n", rounded(F.col("mse")).alias("mse"), rounded(F.col("r2")).alias("r2"))


@query("multi_model_run")
def multi_model_run(spark, sf_dir):
    """A whole training run: two tree models, two linear ones, and their mean R²."""
    run = run_training(star_of(spark, sf_dir), KEY, types=["random_forest", "gradient_boosting", "lasso", "ridge"])
    average = run.summary.agg(F.avg("r_squared").alias("average_r2"))
    return run.summary.select(
        "model_type", "model_target", "total_cases", "num_features", "mean_squared_error", "r_squared"
    ).withColumn("average_r2", average.scalar())


@query("param_grid")
def param_grid(spark, sf_dir):
    """All candidates of the ridge and the boosting grid, by validation R²."""
    train_rows, _, features = _split(spark, sf_dir)
    rows = []
    for model_type, options in (("ridge", M.candidates("ridge")), ("gradient_boosting", M.candidates("gradient_boosting"))):
        best, scores = M.search(train_rows, features, model_type, options, key=F.col(KEY))
        rows += [(model_type, str(option), score, option == best) for option, score in scores]
    return spark.createDataFrame(rows, "model_type string, params string, r2 double, best boolean")


def _ridge_grid_sql():
    placed = """placed AS (SELECT *, age_at_arrest AS x1, prior_misd_cnt AS x2, bail_amount AS y,
  CAST('0x' || substr(md5('42:' || internal_case_id), 1, 15) AS BIGINT) % 1000 < 800 AS fits FROM parts WHERE split = 'train')"""
    fits = ", ".join(
        f"""fit_{i} AS (SELECT *, my - w1 * m1 - w2 * m2 AS w0 FROM (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS w1,
  (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2 FROM (SELECT m1, m2, my, n * s11 + {a} AS a11, n * s12 AS a12,
  n * s22 + {a} AS a22, n * c1 AS b1, n * c2 AS b2 FROM moments)))"""
        for i, a in enumerate(M.PARAM_GRIDS["ridge"]["alpha"])
    )
    scores = " UNION ALL ".join(
        f"""SELECT '{{''alpha'': {a}}}' AS params, 1 - avg(pow(y - w0 - w1 * x1 - w2 * x2, 2)) / var_pop(y) AS r2
  FROM placed, fit_{i} WHERE NOT fits"""
        for i, a in enumerate(M.PARAM_GRIDS["ridge"]["alpha"])
    )
    return f"""{WITH_PARTS}, {placed}, {pair_moments('placed', where='WHERE fits')}, {fits}, scores AS ({scores})
 SELECT params, {r('r2', 9)} AS r2, r2 = max(r2) OVER () AS best FROM scores"""


@query("param_grid_ridge", _ridge_grid_sql())
def param_grid_ridge(spark, sf_dir):
    """The whole ridge grid on a pair of features, scored on the rows that a key hash holds out."""
    train_rows, _, _ = _split(spark, sf_dir)
    best, scores = M.search(train_rows, PAIR, "ridge", M.candidates("ridge"), key=F.col(KEY))
    rows = [(str(option), score, option == best) for option, score in scores]
    return spark.createDataFrame(rows, "params string, r2 double, best boolean").withColumn("r2", rounded(F.col("r2"), 9))


# ---- grouped models ----


def _per_group_sql(column):
    return f"""{WITH_PREPARED}, named AS (SELECT p.*, b.{column} AS target FROM prepared p
  JOIN base b USING (internal_case_id)), {pair_moments('named', 'target')},
 {pair_solution(0.1, 'target', 'WHERE n > 5')}
 SELECT target AS {column}, n, {r('w0')} AS intercept, {r('w1')} AS age_at_arrest, {r('w2')} AS prior_misd_cnt,
  {r('mse')} AS mse, {r('1 - mse / vy')} AS r2 FROM fitted"""


def _prepared(spark, sf_dir, column):
    cohort = materialize(cohort_of(spark, sf_dir).withColumn("target", F.col(column)), "cohort")
    return P.prepare(cohort, [KEY, "target"])


def _per_group(spark, sf_dir, column):
    rows, _ = _prepared(spark, sf_dir, column)
    fitted = G.train_per_group(rows, ["target"], PAIR)
    weights = [rounded(F.col("coefficients")[i]).alias(f) for i, f in enumerate(PAIR)]
    return fitted.select(
        F.col("target").alias(column), "n", *[rounded(F.col(c)).alias(c) for c in ("intercept", "mse", "r2")], *weights
    )


@query("train_per_judge", _per_group_sql("judge_name"))
def train_per_judge(spark, sf_dir):
    return _per_group(spark, sf_dir, "judge_name")


@query("train_per_county", _per_group_sql("county_name"))
def train_per_county(spark, sf_dir):
    return _per_group(spark, sf_dir, "county_name")


@query("train_per_judge_full")
def train_per_judge_full(spark, sf_dir):
    """Every judge's ridge model over all features."""
    rows, learned = _prepared(spark, sf_dir, "judge_name")
    features = [f for f in learned.features if f not in ("judge_name", "county_name", "median_household_income")]
    return G.coefficient_profile(G.train_per_group(rows, ["target"], features), ["target"], features)


def _all_features_sql(column):
    return f"""{WITH_PREPARED} SELECT b.{column} AS {column}, count(*) AS n, CAST(0 AS DOUBLE) AS largest_residual, true AS r2_agrees
 FROM prepared p JOIN base b USING (internal_case_id) GROUP BY b.{column} HAVING count(*) > 5"""


def _all_features(column, constant):
    """Ridge over every feature that varies within a group, held against its normal equations and its own R²."""

    def run(spark, sf_dir):
        rows, learned = _prepared(spark, sf_dir, column)
        features = [f for f in learned.features if f not in constant]
        fitted = materialize(G.train_per_group(rows, ["target"], features), "fitted")
        checked = G.check_fits(rows, fitted, ["target"], features).join(fitted.select("target", "r2"), "target")
        agrees = F.abs(F.col("r2") - F.col("r2_recomputed")) < 1e-9
        return checked.select(
            F.col("target").alias(column), "n", rounded(F.col("largest_residual")).alias("largest_residual"),
            F.coalesce(agrees, F.col("r2").isNull()).alias("r2_agrees"),
        )

    return run


for _column, _constant in (
    ("judge_name", ("judge_name", "county_name", "median_household_income")),
    ("county_name", ("county_name", "median_household_income")),
):
    query(f"train_per_{_column.split('_')[0]}_all", _all_features_sql(_column))(_all_features(_column, _constant))


def _grade_sql(column):
    return f"""{WITH_PREPARED}, {pair_moments('prepared')}, {pair_solution(0.1)},
 scored AS (SELECT b.{column} AS target, p.bail_amount AS y,
  w0 + w1 * p.age_at_arrest + w2 * p.prior_misd_cnt AS p FROM prepared p JOIN base b USING (internal_case_id), fitted)
 SELECT target AS {column}, count(*) AS n, {r('avg(p)')} AS average_predicted, {r('avg(y)')} AS average_actual,
  {r('avg(y - p)')} AS average_difference, {r('avg((y - p) * (y - p))')} AS mse,
  {r('1 - avg((y - p) * (y - p)) / var_pop(y)')} AS r2 FROM scored GROUP BY target HAVING count(*) > 5"""


def _grade(spark, sf_dir, column):
    rows, _ = _prepared(spark, sf_dir, column)
    state = G.fit_state_model(rows, PAIR)
    graded = G.grade(state.predict(rows), ["target"]).withColumnRenamed("target", column)
    measures = [c for c in graded.columns if c not in (column, "n")]
    return graded.select(column, "n", *[rounded(F.col(c)).alias(c) for c in measures])


@query("grade_judges", _grade_sql("judge_name"))
def grade_judges(spark, sf_dir):
    return _grade(spark, sf_dir, "judge_name")


@query("grade_counties", _grade_sql("county_name"))
def grade_counties(spark, sf_dir):
    return _grade(spark, sf_dir, "county_name")


# ---- importance and explanation ----


def _forest(spark, sf_dir, model_type="gradient_boosting"):
    train_rows, test_rows, features = _split(spark, sf_dir)
    return M.train(train_rows, features, model_type, key=F.col(KEY)), test_rows


@query("feature_importance")
def feature_importance(spark, sf_dir):
    model, _ = _forest(spark, sf_dir, "random_forest")
    return model.importance_profile(spark)


@query(
    "permutation_importance",
    f"""{TRAIN_FIT},
 sized AS (SELECT *, greatest(1, CAST(ceil(count(*) OVER () / 65536.0) AS BIGINT)) AS buckets FROM parts WHERE split = 'test'),
 placed AS (SELECT *, CAST('0x' || substr(md5('42:' || internal_case_id), 1, 15) AS BIGINT) % buckets AS bucket,
  CAST('0x' || substr(md5('43:' || internal_case_id), 1, 15) AS BIGINT) AS place FROM sized),
 donors AS (SELECT *,
  coalesce(lead(age_at_arrest) OVER o, first_value(age_at_arrest) OVER o) AS d1,
  coalesce(lead(prior_misd_cnt) OVER o, first_value(prior_misd_cnt) OVER o) AS d2
  FROM placed WINDOW o AS (PARTITION BY bucket ORDER BY place, internal_case_id)),
 errors AS (SELECT avg(pow(bail_amount - (w0 + w1 * age_at_arrest + w2 * prior_misd_cnt), 2)) AS e0,
  avg(pow(bail_amount - (w0 + w1 * d1 + w2 * prior_misd_cnt), 2)) AS e1,
  avg(pow(bail_amount - (w0 + w1 * age_at_arrest + w2 * d2), 2)) AS e2 FROM donors, fitted)
 SELECT 'age_at_arrest' AS Feature, {r('e1 - e0', 9)} AS Importance FROM errors
 UNION ALL SELECT 'prior_misd_cnt', {r('e2 - e0', 9)} FROM errors""",
)
def permutation_importance(spark, sf_dir):
    train_rows, test_rows, _ = _split(spark, sf_dir)
    model = M.train_linear(train_rows, PAIR)
    found = E.permutation_importance(model.predict, test_rows, PAIR, F.col(KEY))
    return found.withColumn("Importance", rounded(F.col("Importance"), 9))


def association_sql():
    labels = " UNION ALL ".join(
        f"SELECT county_name, judge_name, '{c}' AS f, {c} AS v, bail_amount AS y FROM capped WHERE {c} IS NOT NULL"
        for c in CATEGORICAL
    )
    numbers = " UNION ALL ".join(
        f"SELECT county_name, judge_name, '{c}' AS f, CAST({c} AS DOUBLE) AS x, bail_amount AS y FROM capped WHERE {c} IS NOT NULL"
        for c in NUMERIC
    )

    def levels(table, columns):
        return f"""SELECT 'state' AS level, CAST(NULL AS VARCHAR) AS c1, CAST(NULL AS VARCHAR) AS c2, {columns} FROM {table}
  UNION ALL SELECT 'county', county_name, NULL, {columns} FROM {table}
  UNION ALL SELECT 'judge', county_name, judge_name, {columns} FROM {table}"""

    return f"""{WITH_CAPPED}, labels_long AS ({labels}), numbers_long AS ({numbers}),
 cells AS (SELECT level, c1, c2, f, v, count(*) AS c, avg(y) AS m, var_pop(y) * count(*) AS w
  FROM ({levels('labels_long', 'f, v, y')}) GROUP BY ALL),
 eta AS (SELECT level, c1, c2, f, sum(c * m * m) - pow(sum(c * m), 2) / sum(c) AS between_ss, sum(w) AS within_ss
  FROM cells GROUP BY ALL),
 strengths AS (SELECT level, c1, c2, f, CASE WHEN between_ss + within_ss > 1e-3
   THEN between_ss / (between_ss + within_ss) ELSE 0 END AS s FROM eta
  UNION ALL SELECT level, c1, c2, f, CASE WHEN var_pop(x) > 1e-9 AND var_pop(y) > 1e-9 THEN pow(corr(x, y), 2) ELSE 0 END
  FROM ({levels('numbers_long', 'f, x, y')}) GROUP BY level, c1, c2, f),
 profile AS (SELECT level, c1 AS county_name, c2 AS judge_name, f AS Feature,
  coalesce(s / nullif(sum(s) OVER (PARTITION BY level, c1, c2), 0), 0) AS Importance FROM strengths)"""


ASSOCIATION = association_sql()


def associations(spark, sf_dir, levels=tuple(E.LEVELS)):
    capped = P.quantile_cap(P.coerce_target(materialize(cohort_of(spark, sf_dir), "cohort")))
    return E.association_profile(materialize(capped, "capped"), NUMERIC, CATEGORICAL, levels=levels)


@query(
    "association_profile",
    f"{ASSOCIATION} SELECT level, county_name, judge_name, Feature, {r('Importance')} AS Importance FROM profile",
)
def association_profile(spark, sf_dir):
    return associations(spark, sf_dir).withColumn("Importance", rounded(F.col("Importance")))


COMPARED = {"age_at_arrest": "CAST(age_at_arrest AS DOUBLE)", "prior_misd_cnt": number("prior_misd_cnt"),
            "known_days_in_custody": number("known_days_in_custody")}


def _correlations_sql(keys):
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{f}' AS Feature, corr({sql}, bail_amount) AS c FROM capped {group}" for f, sql in COMPARED.items()
    )


def _compare_sql(group, within):
    outer = f"{within}, " if within else ""
    using = f"({within}, Feature)" if within else "(Feature)"
    return f"""{WITH_CAPPED}, mine AS ({_correlations_sql(outer + group)}), general AS ({_correlations_sql(within)}),
 compared AS (SELECT {outer}{group}, Feature, mine.c AS correlation, general.c AS general_correlation,
  mine.c - general.c AS difference FROM mine JOIN general USING {using})
 SELECT {outer}{group}, Feature, {r('correlation')} AS correlation, {r('general_correlation')} AS general_correlation,
  {r('difference')} AS difference,
  CAST(rank() OVER (PARTITION BY {outer}Feature ORDER BY round(difference, 9) DESC NULLS LAST) AS INT) AS rank
 FROM compared"""


def _compare(spark, sf_dir, group, within):
    capped = P.quantile_cap(P.coerce_target(materialize(cohort_of(spark, sf_dir), "cohort")))
    numbers = capped.withColumns({c: to_number(F.col(c)) for c in ("prior_misd_cnt", "known_days_in_custody")})
    found = E.correlation_compare(numbers, list(COMPARED), group=group, within=within)
    return found.withColumns({c: rounded(F.col(c)) for c in ("correlation", "general_correlation", "difference")})


@query("correlation_compare", _compare_sql("county_name", ""))
def correlation_compare(spark, sf_dir):
    """Counties against the state."""
    return _compare(spark, sf_dir, "county_name", None)


@query("correlation_compare_judges", _compare_sql("judge_name", "county_name"))
def correlation_compare_judges(spark, sf_dir):
    """Judges against their county."""
    return _compare(spark, sf_dir, "judge_name", "county_name")


@query(
    "partial_dependence",
    f"""{TRAIN_FIT}, test AS (SELECT * FROM parts WHERE split = 'test'),
 centre AS (SELECT avg(age_at_arrest) AS a1, avg(prior_misd_cnt) AS a2 FROM test)
 SELECT 'age_at_arrest' AS feature, {r('v')} AS "values", {r('w0 + w1 * v + w2 * a2')} AS average
  FROM (SELECT DISTINCT age_at_arrest AS v FROM test), centre, fitted
 UNION ALL SELECT 'prior_misd_cnt', {r('v')}, {r('w0 + w1 * a1 + w2 * v')}
  FROM (SELECT DISTINCT prior_misd_cnt AS v FROM test), centre, fitted""",
)
def partial_dependence(spark, sf_dir):
    train_rows, test_rows, _ = _split(spark, sf_dir)
    found = E.dependence(M.train_linear(train_rows, PAIR), test_rows)
    return found.withColumns({c: rounded(F.col(c)) for c in ("values", "average")})


@query("partial_dependence_forest")
def partial_dependence_forest(spark, sf_dir):
    """All features of a boosted model."""
    model, test_rows = _forest(spark, sf_dir)
    return E.dependence(model, test_rows)


@query("shap_values")
def shap_values(spark, sf_dir):
    model, test_rows = _forest(spark, sf_dir)
    return E.shap_values(test_rows, model.as_forest(), model.features, [KEY])


@query("shap_summary")
def shap_summary(spark, sf_dir):
    model, test_rows = _forest(spark, sf_dir)
    wide = E.shap_values(test_rows, model.as_forest(), model.features, [KEY])
    return E.shap_summary(E.melt_attributions(wide, model.features, [KEY]))


@query(
    "top_features",
    f"{ASSOCIATION} SELECT Feature, {r('Importance')} AS Importance FROM profile WHERE level = 'state' "
    "ORDER BY profile.Importance DESC, Feature LIMIT 20",
)
def top_features(spark, sf_dir):
    state = associations(spark, sf_dir, ["state"]).select("Feature", "Importance")
    return largest(state).withColumn("Importance", rounded(F.col("Importance")))


# ---- the same over every feature ----


@query("train_all")
def train_all(spark, sf_dir):
    """Least squares over all features on the training part."""
    train_rows, _, features = _split(spark, sf_dir)
    weights, intercept = M.train_linear(train_rows, features).linear()
    return spark.createDataFrame(
        [("intercept", intercept), *zip(features, map(float, weights))], "feature string, coefficient double"
    )


@query("predict_all")
def predict_all(spark, sf_dir):
    train_rows, test_rows, features = _split(spark, sf_dir)
    return M.train_linear(train_rows, features).predict(test_rows).select(KEY, "prediction")


@query("model_store_all")
def model_store_all(spark, sf_dir):
    """Predictions of a model over all features after it has been stored and loaded again."""
    train_rows, test_rows, features = _split(spark, sf_dir)
    path = M.train_linear(train_rows, features).save(spark, new_path(spark, "model"))
    return M.load_model(spark, path).predict(test_rows).select(KEY, "prediction")


def _grade_stored(spark, sf_dir, column):
    """Held-out rows of every group against a ridge model over all features, read back from a stored run."""
    star = star_of(spark, sf_dir)
    run = run_training(star, KEY, types=["ridge"])
    stored = persist_run(run, new_path(spark, "graded"))
    return grade_stored(stored, run, "ridge", star, by=column)


@query("grade_judges_stored")
def grade_judges_stored(spark, sf_dir):
    return _grade_stored(spark, sf_dir, "judge_name")


@query("grade_counties_stored")
def grade_counties_stored(spark, sf_dir):
    return _grade_stored(spark, sf_dir, "county_name")


@query("permutation_importance_all")
def permutation_importance_all(spark, sf_dir):
    train_rows, test_rows, features = _split(spark, sf_dir)
    return E.permutation_importance(M.train_linear(train_rows, features).predict, test_rows, features, F.col(KEY))


@query("partial_dependence_all")
def partial_dependence_all(spark, sf_dir):
    train_rows, test_rows, features = _split(spark, sf_dir)
    return E.dependence(M.train_linear(train_rows, features), test_rows)

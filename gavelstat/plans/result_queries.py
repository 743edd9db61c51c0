"""Profiles, result rows, run history and the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelstat.functions.columns import rounded, to_number
from gavelstat.operators import explain as E
from gavelstat.operators import results as S
from gavelstat.plans.catalog import (
    KEY,
    WITH_BASE,
    cohort_of,
    exact_mean,
    number,
    query,
    r,
    star_of,
)
from gavelstat.plans.model_queries import ASSOCIATION, WITH_PARTS, _forest, _split, associations
from gavelstat.plans.training import persist_run, run_training
from gavelstat.schema import FEATURES, TARGET
from gavelstat.sources import outputs as O
from gavelstat.sources.run_log import BATCH, RUN, RunLog
from gavelstat.sources.tpch_star import table
from gavelstat.workspace import drop_at_exit, materialize, new_path


def _importance():
    return rounded(F.col("Importance")).alias("Importance")


@query(
    "compare_profile",
    f"""{ASSOCIATION} SELECT j.judge_name, j.Feature, {r('j.Importance')} AS Importance_judge,
 {r('b.Importance')} AS Importance_baseline, {r('j.Importance - b.Importance')} AS Difference
 FROM profile j JOIN profile b ON j.Feature = b.Feature AND j.level = 'judge' AND b.level = 'state'""",
)
def compare_profile(spark, sf_dir):
    """Every judge's profile against the state's."""
    profiles = materialize(associations(spark, sf_dir, ["state", "judge"]), "profiles")
    state = profiles.filter("level = 'state'").select("Feature", "Importance")
    compared = S.compare_profile(profiles.filter("level = 'judge'"), state, by=["judge_name"])
    measures = ("Importance_judge", "Importance_baseline", "Difference")
    return compared.withColumns({c: rounded(F.col(c)) for c in measures})


# ---- result rows and run history ----

WIDE = ", ".join(f"max(round(Importance, 6)) FILTER (Feature = '{f}') AS {f}_importance" for f in FEATURES)
RESULT_ROWS = f"""{ASSOCIATION} SELECT county_name AS model_target, {WIDE} FROM profile
 WHERE level = 'county' GROUP BY county_name"""


def _county_results(spark, sf_dir):
    profiles = associations(spark, sf_dir, ["county"])
    long = profiles.select(F.col("county_name").alias("model_target"), "Feature", F.round("Importance", 6).alias("Importance"))
    return S.result_rows(long, ["model_target"])


@query("result_row", RESULT_ROWS)
def result_row(spark, sf_dir):
    return _county_results(spark, sf_dir)


@query(
    "append_result",
    RESULT_ROWS,
)
def append_result(spark, sf_dir):
    """Result rows added in two batches, one of them tried twice, and read back."""
    rows = materialize(_county_results(spark, sf_dir), "results")
    early = F.col("model_target") < "NATION_2"
    return _logged(spark, {"early": rows.filter(early), "late": rows.filter(~early)})


def _logged(spark, batches):
    """Batches through a run log; the first is stopped before its commit once, the last is repeated afterwards."""
    log = RunLog(spark, new_path(spark, "log"))
    first, *_, last = batches
    attempt = log.begin("run", first)
    batches[first].write.parquet(f"{log.path}/data/{attempt}")
    for name, rows in [*batches.items(), (last, batches[last])]:
        log.write(rows, "run", name)
    log.clean()
    log.compact(least=len(batches))
    return log.read().drop(RUN, BATCH)


@query(
    "target_type",
    f"""{WITH_BASE}, wanted AS (SELECT DISTINCT CASE WHEN prior_vfo_cnt < '4' THEN judge_name ELSE '' END AS judge,
  CASE WHEN prior_vfo_cnt < '6' THEN county_name END AS county FROM base)
 SELECT judge, county, CASE WHEN judge <> '' THEN 'judge_name' WHEN county <> '' THEN 'county_name' ELSE 'baseline' END
   AS model_target_type, CASE WHEN judge <> '' THEN judge WHEN county <> '' THEN county ELSE 'baseline' END AS model_target
 FROM wanted""",
)
def target_type(spark, sf_dir):
    cohort = cohort_of(spark, sf_dir)
    offences = F.col("prior_vfo_cnt")
    wanted = cohort.select(
        F.when(offences < "4", F.col("judge_name")).otherwise("").alias("judge"),
        F.when(offences < "6", F.col("county_name")).alias("county"),
    ).distinct()
    judge, county = F.col("judge"), F.col("county")
    return wanted.select(
        "judge", "county", S.target_type(judge, county).alias("model_target_type"),
        S.target_name(judge, county).alias("model_target"),
    )


BAIL, MISD = number("first_bail_set_cash"), number("prior_misd_cnt")
FIRST_MODELS = f"""{WITH_BASE}, models AS (
  SELECT county_name AS run_id, 'age' AS model_type, regr_r2({BAIL}, age_at_arrest) AS r_squared FROM base GROUP BY 1
  UNION ALL SELECT county_name, 'misd', regr_r2({BAIL}, {MISD}) FROM base GROUP BY 1)"""


def _fits(cohort, by):
    """R² of two one-feature fits per group."""
    bail = to_number(F.col("first_bail_set_cash"))
    found = cohort.groupBy(*by).agg(
        F.regr_r2(bail, F.col("age_at_arrest")).alias("age"),
        F.regr_r2(bail, to_number(F.col("prior_misd_cnt"))).alias("misd"),
    )
    return found.unpivot(list(by), ["age", "misd"], "model_type", "r_squared")


@query("average_r2", f"{FIRST_MODELS} SELECT run_id, {r('avg(r_squared)')} AS average_r2 FROM models GROUP BY run_id")
def average_r2(spark, sf_dir):
    models = _fits(cohort_of(spark, sf_dir), ["county_name"]).withColumnRenamed("county_name", "run_id")
    return S.average_r2(models).withColumn("average_r2", rounded(F.col("average_r2")))


RUNS = f"""{WITH_BASE}, runs AS (SELECT county_name AS model_target, prior_vfo_cnt AS run_id,
  round(regr_r2({BAIL}, age_at_arrest), 8) AS average_r2 FROM base GROUP BY ALL),
 compared AS (SELECT *, lag(average_r2) OVER (PARTITION BY model_target ORDER BY run_id) AS previous_r2 FROM runs)
 SELECT model_target, run_id, average_r2, previous_r2, CASE WHEN previous_r2 IS NULL THEN 'No previous R² value'
  WHEN average_r2 > previous_r2 THEN 'R² increased by ' || printf('%.4f', average_r2 - previous_r2)
  WHEN average_r2 < previous_r2 THEN 'R² decreased by ' || printf('%.4f', previous_r2 - average_r2)
  ELSE 'R² stayed the same' END AS r2_comparison FROM compared"""


def _runs(spark, sf_dir):
    """One run per county and number of prior offences, in that order of time."""
    bail = to_number(F.col("first_bail_set_cash"))
    fitted = cohort_of(spark, sf_dir).groupBy(F.col("county_name").alias("model_target"), F.col("prior_vfo_cnt").alias("run_id"))
    runs = fitted.agg(F.round(F.regr_r2(bail, F.col("age_at_arrest")), 8).alias("average_r2"))
    return runs.withColumn("run_ts", F.timestamp_seconds(F.col("run_id").cast("int")))


@query("compare_r2", RUNS)
def compare_r2(spark, sf_dir):
    return S.compare_runs(_runs(spark, sf_dir)).drop("run_ts")


@query("run_history", RUNS)
def run_history(spark, sf_dir):
    """The same comparison over a run log filled by two batches, one of them tried twice."""
    runs = materialize(_runs(spark, sf_dir), "runs")
    logged = _logged(spark, {"early": runs.filter("run_id < '4'"), "late": runs.filter("run_id >= '4'")})
    return S.compare_runs(logged).drop("run_ts")


@query(
    "metric_names",
    r"SELECT regexp_replace('importance_' || p_brand, '[^a-zA-Z0-9_\- .]', '_', 'g') AS metric, "
    "avg(p_size) AS value FROM part GROUP BY p_brand",
)
def metric_names(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("Feature")).agg(F.avg("p_size").alias("Importance"))
    return S.named_metrics(sizes)


@query(
    "model_params",
    """SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '","type":"' || event_type || '"}' AS model_params,
 CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""",
)
def model_params(spark, sf_dir):
    """Parameters as JSON text, and one of them read back."""
    events = table(spark, sf_dir, "events")
    given = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    stored = events.select("event_id", S.params_json(given).alias("model_params"))
    return stored.withColumn("k", F.get_json_object("model_params", "$.k").cast("int"))


@query(
    "run_duration",
    f"SELECT user_id, {r('epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6', 3)} AS time_elapsed FROM events GROUP BY user_id",
)
def run_duration(spark, sf_dir):
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    return S.with_duration(spans).select("user_id", rounded(F.col("time_elapsed"), 3).alias("time_elapsed"))


@query(
    "persisted_run",
    f"""{WITH_BASE}, models(model_type, model_params) AS (VALUES ('lasso', '{{"alpha": 0.1}}'), ('ridge', '{{"alpha": 0.1}}'))
 SELECT 'baseline' AS model_target_type, 'baseline' AS model_target, model_type, model_params,
  {r(exact_mean('first_bail_set_cash'))} AS average_bail_amount, count(*) AS total_cases, 15 AS num_features,
  'No previous R² value' AS r2_comparison, true AS measured, 15 AS importances FROM base, models GROUP BY model_type, model_params""",
)
def persisted_run(spark, sf_dir):
    """The wide rows of a run, as stored and read back."""
    run = run_training(star_of(spark, sf_dir), KEY, types=["lasso", "ridge"])
    folder = new_path(spark, "runs")
    drop_at_exit(spark, folder)
    rows = O.read_runs(spark, persist_run(run, folder).results)
    found = [F.col(f"{f}_importance").isNotNull().cast("int") for f in FEATURES]
    measured = (F.col("time_elapsed") > 0) & (F.col("mean_squared_error") > 0) & F.col("average_r2").isNotNull()
    return rows.select(
        "model_target_type", "model_target", "model_type", "model_params",
        rounded(F.col("average_bail_amount")).alias("average_bail_amount"), "total_cases", "num_features", "r2_comparison",
        measured.alias("measured"), sum(found[1:], found[0]).alias("importances"),
    )


# ---- sinks ----


@query(
    "read_profile_csv",
    f"{ASSOCIATION} SELECT Feature, {r('Importance')} AS Importance FROM profile WHERE level = 'state'",
)
def read_profile_csv(spark, sf_dir):
    """The state profile, written as CSV and read with a declared schema."""
    path = new_path(spark, "profile")
    O.write_profile_csv(associations(spark, sf_dir, ["state"]), path)
    return O.read_profile_csv(spark, path).select("Feature", _importance())


@query(
    "write_profile",
    f"{ASSOCIATION} SELECT level, county_name, judge_name, Feature, {r('Importance')} AS Importance FROM profile",
)
def write_profile(spark, sf_dir):
    """Profiles of all levels stored by level; one level is rewritten without touching the others."""
    profiles = materialize(associations(spark, sf_dir), "associations")
    path = new_path(spark, "profiles")
    O.write_profiles(profiles, path, ["level"])
    O.write_profiles(profiles.filter("level = 'county'"), path, ["level"])
    stored = spark.read.schema(profiles.schema).parquet(path)
    return stored.select("level", "county_name", "judge_name", "Feature", _importance())


SUMS = ", ".join(f"{r(f'sum({c})', 4)} AS {c}" for c in [TARGET, *FEATURES])


@query("write_features", f"{WITH_PARTS} SELECT split, count(*) AS n, {SUMS} FROM parts GROUP BY split")
def write_features(spark, sf_dir):
    train_rows, test_rows, _ = _split(spark, sf_dir)
    path = O.write_features(train_rows.unionByName(test_rows), new_path(spark, "features"))
    stored = O.read_features(spark, path)
    sums = [rounded(F.sum(c), 4).alias(c) for c in [TARGET, *FEATURES]]
    return stored.groupBy("split").agg(F.count("*").alias("n"), *sums)


@query(
    "write_attributions",
    f"""{WITH_PARTS} SELECT feature, count(*) AS n_rows, count(DISTINCT internal_case_id) AS n_cases FROM parts,
 (SELECT unnest([{', '.join(repr(f) for f in FEATURES)}]) AS feature) WHERE split = 'test' GROUP BY feature""",
)
def write_attributions(spark, sf_dir):
    """Attributions of every test row, stored in long form and counted."""
    model, test_rows = _forest(spark, sf_dir)
    long = E.melt_attributions(E.shap_values(test_rows, model.as_forest(), model.features, [KEY]), model.features, [KEY])
    stored = spark.read.parquet(O.write_attributions(long, new_path(spark, "attributions")))
    return stored.filter(F.col("value").isNotNull()).groupBy("feature").agg(
        F.count("*").alias("n_rows"), F.count_distinct(KEY).alias("n_cases")
    )

"""The composed runs: train on a cohort, grade judges or counties with the result."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, fields
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstat.functions.columns import exact_mean
from gavelstat.operators import cohort as K
from gavelstat.operators import explain as E
from gavelstat.operators import grouped as G
from gavelstat.operators import models as M
from gavelstat.operators import prepare as P
from gavelstat.operators import results as S
from gavelstat.operators.split import stratified_split
from gavelstat.schema import RAW_TARGET, Star
from gavelstat.sources import outputs as O
from gavelstat.workspace import materialize, release

RUN_SCHEMA = (
    "run_id string, model_target_type string, model_target string, model_type string, model_params string, "
    "average_bail_amount double, total_cases bigint, num_features int, mean_squared_error double, r_squared double, "
    "started_at timestamp, ended_at timestamp"
)


@dataclass(frozen=True)
class TrainingRun:
    """What a training run leaves behind: split rows, preparation, models and one row per model."""

    rows: DataFrame
    preparation: P.Preparation
    models: list[M.FittedModel]
    summary: DataFrame
    profiles: DataFrame

    @property
    def train_rows(self) -> DataFrame:
        return self.rows.filter(F.col("split") == "train")

    @property
    def test_rows(self) -> DataFrame:
        return self.rows.filter(F.col("split") == "test")


def prepared_split(
    star: Star, key: str, judge: str | None = None, county: str | None = None, carry: Sequence[str] = (), seed: int = 42,
    fit_on: str = "all", **options,
) -> tuple[DataFrame, DataFrame, P.Preparation]:
    """Stored cohort, stored split of its prepared rows, and the preparation.

    ``carry`` keeps cohort columns as labels beside their encoded form, named ``<column>_label``.
    ``fit_on='all'`` learns the preparation from all rows, test rows included; ``'train'`` learns it
    from the training part alone, whose rows are then chosen by the raw amount.
    """
    raw = K.require_columns(K.base_cohort(star, judge, county, keep=[key]))
    cohort = materialize(raw.withColumns({f"{c}_label": F.col(c) for c in carry}), "cohort")
    keep = [key, *[f"{c}_label" for c in carry]]
    if fit_on == "train":
        learned, rows = _fit_on_train(cohort, key, keep, seed, options)
    else:
        prepared, learned = P.prepare(cohort, keep, **options)
        rows = stratified_split(prepared, F.col(key), seed=seed)
    return cohort, materialize(rows, "split"), learned


def _fit_on_train(cohort, key, keep, seed, options):
    parsed = P.coerce_target(cohort.select(key, "first_bail_set_cash"))
    capped = materialize(P.quantile_cap(materialize(parsed, "target")), "capped")
    parts = materialize(stratified_split(capped, F.col(key), seed=seed).select(key, "stratum", "split"), "parts")
    labelled = cohort.join(parts, key)
    train_rows = materialize(labelled.filter("split = 'train'").drop("stratum", "split"), "train")
    learned = P.fit(train_rows, keep, cap_quantile=1.0, **options)  # the cap has been applied already
    return learned, learned.transform(labelled, [*keep, "stratum", "split"], unseen="keep")


def run_training(
    star: Star, key: str = "internal_case_id", judge: str | None = None, county: str | None = None,
    types: Sequence[str] = tuple(M.DEFAULT_TYPES), params: dict[str, dict] | None = None, seed: int = 42, **options,
) -> TrainingRun:
    """Cohort, preparation, split, one model per type, their metrics and importance profiles.

    The cohort is read once; average amount and case count come from it before the cap.
    """
    spark = star.cases.sparkSession
    started = time.time()
    cohort, rows, learned = prepared_split(star, key, judge, county, seed=seed, **options)
    train_rows, test_rows = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    fitted = M.run_models(train_rows, test_rows, learned.features, types, params, key=F.col(key))
    totals = cohort.agg(exact_mean(F.col(RAW_TARGET)), F.count("*")).first()
    target_type = "judge_name" if judge else "county_name" if county else "baseline"
    target = judge or county or "baseline"
    begin, end = (datetime.fromtimestamp(t, timezone.utc) for t in (started, time.time()))
    run_id = f"{begin.strftime('%Y%m%dT%H%M%S%f')}-{seed}-{hashlib.md5(target.encode()).hexdigest()[:8]}"
    summary = spark.createDataFrame(
        [
            (run_id, target_type, target, m.model_type, json.dumps(m.params), totals[0], totals[1],
             len(learned.features), mse, r2, begin, end)
            for m, mse, r2 in fitted
        ],
        RUN_SCHEMA,
    )
    named = [(m.model_type, _profile(spark, m, test_rows, key)) for m, _, _ in fitted]
    profiles = reduce(
        DataFrame.unionByName,
        [p.select(F.lit(run_id).alias("run_id"), F.lit(t).alias("model_type"), "Feature", "Importance") for t, p in named],
    )
    return TrainingRun(rows, learned, [m for m, _, _ in fitted], summary, profiles)


def _profile(spark: SparkSession, model: M.FittedModel, test_rows: DataFrame, key: str) -> DataFrame:
    """The model's own importances; what permuting a feature costs on the test rows where it has none."""
    if model.importances() is not None:
        return model.importance_profile(spark)
    return E.permutation_importance(model.predict, test_rows, model.features, F.col(key))


@dataclass(frozen=True)
class StoredRun:
    """Folders of a persisted run."""

    results: str
    profiles: str
    models: str
    attributions: str
    comparison: str


def persist_run(
    run: TrainingRun, folder: str, baseline: DataFrame | None = None, key: str = "internal_case_id"
) -> StoredRun:
    """Write what a training run found below ``folder``; a retry of the same run replaces its own files.

    ``results`` gets a wide row per model: run columns, metrics, parameters, elapsed seconds, importances, the run's
    mean R² and how it compares with the previous run on the same target.  Models go to ``models/<run>/<type>``,
    profiles and, with a ``baseline`` profile, their differences from it to tables of their own, attributions of
    tree models to ``attributions``.
    """
    spark = run.summary.sparkSession
    stored = StoredRun(*[f"{folder}/{f.name}" for f in fields(StoredRun)])
    run_id, target = run.summary.select("run_id", "model_target").first()
    profiles = materialize(run.profiles, "profiles")
    wide = S.with_duration(run.summary).join(S.result_rows(profiles, S.RUN_KEYS), S.RUN_KEYS, "left")
    earlier = O.read_runs(spark, stored.results)
    before = None
    if earlier is not None:
        previous = S.average_r2(
            earlier.filter((F.col("model_target") == target) & (F.col("run_id") < run_id)), ("run_id",)
        )
        before = previous.agg(F.max_by("average_r2", "run_id")).first()[0]
    average = run.summary.agg(F.avg("r_squared")).first()[0]
    compared = S.describe_change(F.lit(before).cast("double"), F.lit(average).cast("double"))
    O.write_runs(
        wide.withColumns({"average_r2": F.lit(average).cast("double"), "r2_comparison": compared}), stored.results
    )
    O.write_runs(profiles, stored.profiles)
    if baseline is not None:
        O.write_runs(S.compare_profile(profiles, baseline, S.RUN_KEYS), stored.comparison)
    for model in run.models:
        model.save(spark, f"{stored.models}/{run_id}/{model.model_type}")
        forest = model.as_forest()
        if forest is not None and forest.combine == "sum":
            wide_phi = E.shap_values(run.test_rows, forest, model.features, [key])
            long = E.melt_attributions(wide_phi, model.features, [key])
            O.write_attributions(long, f"{stored.attributions}/{run_id}/{model.model_type}")
    release(profiles)
    return stored


def grade_stored(
    stored: StoredRun, run: TrainingRun, model_type: str, star: Star, by: str = "judge_name", key: str = "internal_case_id"
) -> DataFrame:
    """Grade judges or counties by a model read from storage, on the rows that its training held out."""
    spark = star.cases.sparkSession
    run_id = run.summary.select("run_id").first()[0]
    model = M.load_model(spark, f"{stored.models}/{run_id}/{model_type}")
    names = K.base_cohort(star, keep=[key]).select(key, F.col(by).alias("__target"))
    return G.grade(model.predict(run.test_rows.join(names, key)), ["__target"]).withColumnRenamed("__target", by)


def run_grading(
    star: Star, model: M.FittedModel | G.LinearModel, preparation: P.Preparation, by: str = "judge_name",
    key: str = "internal_case_id", limit: int | None = None,
) -> DataFrame:
    """Grade every judge or county: one scoring pass over the cohort, one aggregation.

    The group's name is carried beside its code, so nothing the model needs is dropped.
    """
    cohort = K.base_cohort(star, keep=[key]).withColumn("__target", F.col(by))
    rows = preparation.transform(cohort, [key, "__target"], unseen="keep")
    return G.grade(model.predict(rows), ["__target"], limit=limit).withColumnRenamed("__target", by)

"""Result rows, run history and profile comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelstat.functions.columns import metric_name
from gavelstat.schema import FEATURES, R2_DOWN, R2_NO_PREVIOUS, R2_SAME, R2_UP

RUN_KEYS = ["run_id", "model_type"]


def compare_profile(profile: DataFrame, baseline: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Importances of features found in both profiles, and their difference.

    ``by`` names further key columns of ``profile``, such as the judge, when it holds many
    profiles at once.
    """
    mine = profile.select(*by, "Feature", F.col("Importance").alias("Importance_judge"))
    base = baseline.select("Feature", F.col("Importance").alias("Importance_baseline"))
    return mine.join(base, "Feature").withColumn(
        "Difference", F.col("Importance_judge") - F.col("Importance_baseline")
    )


def top_features(profile: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most important features, by name on ties."""
    return profile.orderBy(F.desc("Importance"), "Feature").limit(n)


def result_rows(profiles: DataFrame, by: Sequence[str], features: Sequence[str] = FEATURES) -> DataFrame:
    """One wide row per model from long importances; an absent feature gives NULL.

    A feature outside ``features`` has no column to go to and raises.
    """
    known = F.col("Feature").isin(list(features))
    message = F.concat(F.lit("no result column for feature "), F.col("Feature"))
    checked = profiles.withColumn("Feature", F.when(known, F.col("Feature")).otherwise(F.raise_error(message)))
    wide = checked.groupBy(*by).pivot("Feature", list(features)).agg(F.max("Importance"))
    return wide.select(*by, *[F.col(f).alias(f"{f}_importance") for f in features])


def target_type(judge: Column, county: Column) -> Column:
    """What a model is about: a judge, else a county, else everyone."""
    return F.when(_given(judge), "judge_name").when(_given(county), "county_name").otherwise("baseline")


def target_name(judge: Column, county: Column) -> Column:
    return F.when(_given(judge), judge).when(_given(county), county).otherwise("baseline")


def _given(name: Column) -> Column:
    return name.isNotNull() & (name != "")


def average_r2(models: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Mean R² over the models of each run."""
    return models.groupBy(*by).agg(F.avg("r_squared").alias("average_r2"))


def describe_change(previous: Column, current: Column) -> Column:
    """Wording of the change of R² against the previous run, to four decimals."""
    up = F.concat(F.lit(R2_UP), _four(current - previous))
    down = F.concat(F.lit(R2_DOWN), _four(previous - current))
    return (
        F.when(previous.isNull(), R2_NO_PREVIOUS)
        .when(current > previous, up)
        .when(current < previous, down)
        .otherwise(R2_SAME)
    )


def _four(value: Column) -> Column:
    return F.format_string("%.4f", value)


def compare_runs(runs: DataFrame) -> DataFrame:
    """Each run against the one before it on the same target.

    Run history holds one row per run, so a target's window stays small.
    """
    before = F.lag("average_r2").over(Window.partitionBy("model_target").orderBy("run_ts", "run_id"))
    return runs.withColumn("previous_r2", before).withColumn(
        "r2_comparison", describe_change(F.col("previous_r2"), F.col("average_r2"))
    )


def named_metrics(profile: DataFrame) -> DataFrame:
    """Importances under metric names."""
    return profile.select(metric_name(F.col("Feature")).alias("metric"), F.col("Importance").alias("value"))


def params_json(params: Column) -> Column:
    """A parameter map as JSON text."""
    return F.to_json(params)


def with_duration(runs: DataFrame) -> DataFrame:
    """Elapsed seconds from the start and end stored with each run."""
    begin, end = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("started_at", "ended_at"))
    return runs.withColumn("time_elapsed", (end - begin) / 1_000_000)

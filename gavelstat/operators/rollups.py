"""Summaries per judge, court, charge, race, representation and county.

Each measure is a plain aggregate, combined before the shuffle, so a judge or county
with a third of all cases moves no more rows than any other.  Joins to the dimensions
come after the aggregation wherever the key allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelstat.functions.columns import exact_mean, mean_of_parts, mean_parts, rounded, severity_weight, to_number
from gavelstat.operators.prepare import bin_column
from gavelstat.schema import RAW_TARGET, TARGET, Star
from gavelstat.workspace import materialize


def _amount() -> Column:
    return to_number(F.col(RAW_TARGET))


def _is_yes(column: str) -> Column:
    return F.col(column) == "Y"


def _count_yes(column: str, name: str) -> Column:
    return F.count_if(_is_yes(column)).alias(name)


def _percent(condition: Column, name: str) -> Column:
    flag = F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)
    return (F.avg(flag) * 100).alias(name)


def _labels(column: str, name: str) -> Column:
    """Sorted distinct labels; as many as the small label domain has."""
    return F.array_sort(F.collect_set(column)).alias(name)


def average_target(df: DataFrame, column: str = RAW_TARGET) -> DataFrame:
    """Mean of the parsed amounts."""
    return df.agg(exact_mean(F.col(column)).alias("average_bail_amount"))


def case_totals(df: DataFrame, features: int) -> DataFrame:
    """Number of cases and of model features."""
    return df.agg(F.count("*").alias("total_cases")).withColumn("num_features", F.lit(features))


def rollup_judge(star: Star) -> DataFrame:
    """Per judge: counts, averages and the distinct labels met.

    The fact table is aggregated once; names of districts, courts and so on are looked up
    from the stored per-judge rows.

    ``average_sentence_severity`` is the mean weight of the charge at conviction;
    ``rearrest_rate`` the share of cases with a rearrest.
    """
    measures = star.cases.groupBy("judge_id").agg(
        exact_mean(F.col(RAW_TARGET)).alias("average_bail_set"),
        F.count("*").alias("case_count"),
        F.collect_set("district_id").alias("district_ids"),
        F.collect_set("county_id").alias("county_ids"),
        F.collect_set("court_id").alias("court_ids"),
        F.collect_set("representation_id").alias("representation_ids"),
        _labels("top_charge_at_arraign", "top_charges_at_arraign"),
        _labels("disposition_type", "disposition_types"),
        _labels("pretrial_supervision_at_arraign", "supervision_conditions"),
        _labels("arraign_charge_category", "offense_types"),
        _count_yes("remanded_to_jail_at_arraign", "remand_to_jail_count"),
        _count_yes("ror_at_arraign", "ror_count"),
        _count_yes("bail_set_and_posted_at_arraign", "bail_set_and_posted_count"),
        _count_yes("bail_set_and_not_posted_at_arraign", "bail_set_and_not_posted_count"),
        F.avg(
            F.when(F.col("top_charge_weight_at_conviction").isNotNull(),
                   severity_weight(F.col("top_charge_weight_at_conviction")))
        ).alias("average_sentence_severity"),
        F.avg(_is_yes("rearrest").cast("double")).alias("rearrest_rate"),
    )
    per_judge = materialize(measures, "judges")
    named = star.judges.select("judge_uuid", "judge_name").join(per_judge, F.col("judge_uuid") == F.col("judge_id"))
    for ids, dim, uid, label, name in (
        ("district_ids", star.districts, "district_uuid", "district_name", "unique_districts"),
        ("county_ids", star.counties, "county_uuid", "county_name", "counties"),
        ("court_ids", star.courts, "court_uuid", "court_name", "court_names"),
        ("representation_ids", star.representation, "representation_uuid", "representation_type",
         "representation_types"),
    ):
        pairs = per_judge.select("judge_id", F.explode(ids).alias("__id"))
        known = dim.select(F.col(uid).alias("__id"), F.col(label).alias("__label"))
        names = pairs.join(known, "__id").groupBy("judge_id").agg(_labels("__label", name))
        named = named.drop(ids).join(names, "judge_id", "left")
    return named.drop("judge_id", "judge_uuid")


def judge_cases(star: Star) -> DataFrame:
    """Number of cases per judge."""
    counted = star.cases.groupBy("judge_id").agg(F.count("*").alias("case_count"))
    judges = star.judges.select("judge_uuid", "judge_name")
    return judges.join(counted, F.col("judge_uuid") == F.col("judge_id")).select("judge_name", "case_count")


def _amounts_by(star: Star, key: str, dimension: DataFrame, uid: str, label: str) -> DataFrame:
    per_key = star.cases.groupBy(key).agg(
        exact_mean(F.col(RAW_TARGET)).alias("average_bail_amount"), F.count("*").alias("number_of_cases")
    )
    return dimension.select(uid, label).join(per_key, F.col(uid) == F.col(key)).drop(uid, key)


def rollup_court(star: Star) -> DataFrame:
    return _amounts_by(star, "court_id", star.courts, "court_uuid", "court_name")


def rollup_charge(star: Star) -> DataFrame:
    return _amounts_by(star, "crime_id", star.crimes, "crime_uuid", "top_charge_at_arrest")


def rollup_county(star: Star) -> DataFrame:
    """Per county: average amount, cases and the median income, if the county has one."""
    counties = _amounts_by(star, "county_id", star.counties, "county_uuid", "county_name")
    income = star.ny_income.select(
        F.col("county").alias("county_name"), F.col("median_household_income").alias("median_income")
    )
    return counties.join(income, "county_name", "left")


def _outcomes_by(star: Star, key: str, dimension: DataFrame, uid: str, label: str) -> DataFrame:
    """Average amount and days, and the percentage of each release decision.

    Bail counts as set whether or not it was posted; a case is disposed at arraignment if
    it has a disposition.
    """
    bail_set = _is_yes("bail_set_and_posted_at_arraign") | _is_yes("bail_set_and_not_posted_at_arraign")
    per_key = star.cases.groupBy(key).agg(
        exact_mean(F.col(RAW_TARGET)).alias("average_bail_amount"),
        F.count("*").alias("number_of_cases"),
        F.avg(to_number(F.col("known_days_in_custody"))).alias("average_known_days_in_custody"),
        _percent(_is_yes("remanded_to_jail_at_arraign"), "remanded_percentage"),
        _percent(bail_set, "bail_set_percentage"),
        _percent(F.col("disposition_type").isNotNull(), "disposed_at_arraign_percentage"),
        _percent(_is_yes("ror_at_arraign"), "ror_percentage"),
        _percent(_is_yes("nmr_at_arraign"), "nonmonetary_release_percentage"),
    )
    return dimension.select(uid, label).join(per_key, F.col(uid) == F.col(key)).drop(uid, key)


def rollup_race(star: Star) -> DataFrame:
    return _outcomes_by(star, "race_id", star.races, "race_uuid", "race")


def rollup_representation(star: Star) -> DataFrame:
    return _outcomes_by(
        star, "representation_id", star.representation, "representation_uuid", "representation_type"
    )


def rollup_all_levels(cohort: DataFrame) -> DataFrame:
    """State, county and judge averages in one pass over the cohort.

    The finest level is aggregated first and rolled up from there, so the cohort is not
    repeated per level as grouping sets over rows would.
    """
    parts = mean_parts(F.col(RAW_TARGET))
    finest = cohort.groupBy("county_name", "judge_name").agg(
        *[c.alias(n) for n, c in parts.items()], F.count("*").alias("cases")
    )
    return (
        finest.rollup("county_name", "judge_name")
        .agg(
            mean_of_parts(*[F.sum(n) for n in parts]).alias("average_bail_amount"),
            F.sum("cases").alias("number_of_cases"),
            F.grouping_id().alias("__level"),
        )
        .withColumn("level", F.when(F.col("__level") == 3, "state").when(F.col("__level") == 1, "county").otherwise("judge"))
        .drop("__level")
    )


def target_by_disposition(cases: DataFrame, bins: int = 10) -> DataFrame:
    """Amount interval against disposition: cases and average amount per cell."""
    amounts = cases.withColumn(TARGET, _amount()).filter(F.col(TARGET).isNotNull())
    return (
        bin_column(amounts, TARGET, bins)
        .groupBy("disposition_type", "bin")
        .agg(F.count("*").alias("n"), exact_mean(F.col(RAW_TARGET)).alias("average_bail_amount"))
    )


def county_overview(cohort: DataFrame) -> DataFrame:
    """Per county: cases, judges, average amount, income and its correlation with prior offences."""
    amount = _amount()
    return cohort.groupBy("county_name").agg(
        F.count("*").alias("n"),
        F.count_distinct("judge_name").alias("judges"),
        rounded(exact_mean(F.col(RAW_TARGET))).alias("avg_bail"),
        rounded(F.max("median_household_income")).alias("income"),
        rounded(F.corr(to_number(F.col("prior_misd_cnt")), amount)).alias("corr_misd"),
    )

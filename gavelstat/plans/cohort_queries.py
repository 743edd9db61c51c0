"""Sources, projection, predicates and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelstat.operators import cohort as K
from gavelstat.operators import rollups as R
from gavelstat.plans.catalog import (
    COHORT_LIST,
    INCOME,
    KEY,
    RACES,
    WITH_BASE,
    WITH_CASES,
    WITH_JOINED,
    cohort_of,
    exact_mean,
    number,
    query,
    r,
    star_of,
)
from gavelstat.schema import COHORT_COLUMNS, QUERY_LIMIT
from gavelstat.sources.star import read_star as stored_star
from gavelstat.sources.star import table_sizes, write_star
from gavelstat.workspace import drop_at_exit, materialize, new_path

CASE_COLUMNS = [KEY, "first_bail_set_cash", "top_charge_weight_at_arraign", "known_days_in_custody"]
CASE_LIST = ", ".join(CASE_COLUMNS)


@query(
    "read_star",
    f"""{WITH_CASES}, {INCOME}, {RACES}
SELECT 'cases' AS table_name, count(*) AS n_rows FROM cases
UNION ALL SELECT 'judges', count(*) FROM supplier
UNION ALL SELECT 'courts', count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'crimes', count(DISTINCT p_type) FROM part
UNION ALL SELECT 'races', count(*) FROM races
UNION ALL SELECT 'representation', count(*) FROM nation
UNION ALL SELECT 'ny_income', count(*) FROM ny_income
UNION ALL SELECT 'counties', count(*) FROM nation
UNION ALL SELECT 'districts', count(*) FROM region""",
)
def read_star(spark, sf_dir):
    """The star written and read back by the library's own reader."""
    folder = new_path(spark, "star")
    write_star(star_of(spark, sf_dir), folder)
    drop_at_exit(spark, folder)
    return table_sizes(stored_star(spark, folder))


def _rounded_income(df):
    return df.withColumn("median_household_income", F.round("median_household_income", 6))


INCOME_ROUNDED = COHORT_LIST.replace(
    "median_household_income", "round(median_household_income, 6) AS median_household_income"
)


@query("base_project", f"{WITH_JOINED} SELECT {INCOME_ROUNDED} FROM joined")
def base_project(spark, sf_dir):
    star = star_of(spark, sf_dir)
    joined = K.join_judge(K.join_income(K.join_county(K.join_race(star.cases, star), star), star), star)
    return _rounded_income(joined.select(*COHORT_COLUMNS))


@query(
    "filter_not_null",
    f"{WITH_CASES} SELECT {CASE_LIST} FROM cases "
    "WHERE first_bail_set_cash IS NOT NULL AND top_charge_weight_at_arraign IS NOT NULL",
)
def filter_not_null(spark, sf_dir):
    return K.with_recorded_amount(star_of(spark, sf_dir).cases).select(*CASE_COLUMNS)


@query(
    "filter_amount_range",
    f"{WITH_CASES} SELECT {CASE_LIST} FROM cases WHERE TRY_CAST(first_bail_set_cash AS DOUBLE) < 39000 "
    "AND TRY_CAST(first_bail_set_cash AS DOUBLE) > 1",
)
def filter_amount_range(spark, sf_dir):
    return K.amount_in_range(star_of(spark, sf_dir).cases).select(*CASE_COLUMNS)


@query(
    "filter_days_outlier",
    f"{WITH_CASES} SELECT {CASE_LIST} FROM cases WHERE TRY_CAST(known_days_in_custody AS DOUBLE) < 100",
)
def filter_days_outlier(spark, sf_dir):
    return K.days_below(star_of(spark, sf_dir).cases).select(*CASE_COLUMNS)


@query(
    "filter_judge",
    f"{WITH_BASE} SELECT * EXCLUDE (judge_name) REPLACE (round(median_household_income, 6) AS median_household_income) "
    "FROM base WHERE judge_name = (SELECT min(s_name) FROM supplier)",
)
def filter_judge(spark, sf_dir):
    judge = star_of(spark, sf_dir).judges.agg(F.min("judge_name")).first()[0]
    return _rounded_income(cohort_of(spark, sf_dir, judge=judge))


@query(
    "filter_county",
    f"{WITH_BASE} SELECT * EXCLUDE (county_name, median_household_income) FROM base "
    "WHERE county_name = (SELECT min(n_name) FROM nation)",
)
def filter_county(spark, sf_dir):
    county = star_of(spark, sf_dir).counties.agg(F.min("county_name")).first()[0]
    return cohort_of(spark, sf_dir, county=county)


LISTED_COUNTIES = [f"NATION_{i}" for i in range(1, 10)]


@query(
    "query_params",
    f"""{WITH_BASE} SELECT internal_case_id, judge_name, county_name, first_bail_set_cash FROM base
 WHERE county_name IN ({', '.join(repr(c) for c in LISTED_COUNTIES)})
 ORDER BY md5('42:' || internal_case_id) LIMIT {QUERY_LIMIT}""",
)
def query_params(spark, sf_dir):
    cohort = materialize(cohort_of(spark, sf_dir), "cohort")
    picked = K.restrict(cohort, counties=LISTED_COUNTIES, limit=QUERY_LIMIT)
    return picked.select(KEY, "judge_name", "county_name", "first_bail_set_cash")


@query(
    "eligible_judges",
    f"""{WITH_JOINED}, stats AS (SELECT judge_name, count(*) AS case_count FROM joined GROUP BY judge_name)
 SELECT DISTINCT judge_name FROM stats WHERE case_count > 5""",
)
def eligible_judges(spark, sf_dir):
    star = star_of(spark, sf_dir)
    return K.eligible_targets(R.judge_cases(star), "judge_name", "case_count")


@query(
    "eligible_counties",
    f"""{WITH_JOINED}, stats AS (SELECT county_name, count(*) AS n FROM joined GROUP BY county_name)
 SELECT DISTINCT county_name FROM stats WHERE n > 5""",
)
def eligible_counties(spark, sf_dir):
    star = star_of(spark, sf_dir)
    return K.eligible_targets(R.rollup_county(star), "county_name", "number_of_cases")


@query("unique_values", f"{WITH_BASE} SELECT DISTINCT ethnicity FROM base")
def unique_values(spark, sf_dir):
    return K.unique_values(cohort_of(spark, sf_dir), "ethnicity")


@query(
    "require_columns",
    f"{WITH_BASE} SELECT count(*) AS n_rows, count(first_bail_set_cash) AS n_amounts, "
    "count(top_charge_weight_at_arraign) AS n_weights FROM base",
)
def require_columns(spark, sf_dir):
    checked = K.require_columns(cohort_of(spark, sf_dir))
    return checked.agg(
        F.count("*").alias("n_rows"),
        F.count("first_bail_set_cash").alias("n_amounts"),
        F.count("top_charge_weight_at_arraign").alias("n_weights"),
    )


@query(
    "preview",
    f"{WITH_BASE} SELECT * REPLACE (round(median_household_income, 6) AS median_household_income) FROM base "
    "ORDER BY internal_case_id LIMIT 10",
)
def preview(spark, sf_dir):
    return _rounded_income(K.preview(cohort_of(spark, sf_dir), [KEY]))


@query(
    "join_race",
    f"{WITH_CASES}, {RACES} SELECT internal_case_id, race FROM cases JOIN races ON race_id = race_uuid",
)
def join_race(spark, sf_dir):
    star = star_of(spark, sf_dir)
    return K.join_race(star.cases, star).select(KEY, "race")


@query(
    "join_county",
    f"{WITH_CASES} SELECT internal_case_id, n_name AS county_name FROM cases JOIN nation ON county_id = n_nationkey",
)
def join_county(spark, sf_dir):
    star = star_of(spark, sf_dir)
    return K.join_county(star.cases, star).select(KEY, "county_name")


@query(
    "join_income",
    f"""{WITH_CASES}, {INCOME} SELECT internal_case_id, county, {r('median_household_income')} AS income
 FROM cases JOIN nation ON county_id = n_nationkey JOIN ny_income ON n_name = county""",
)
def join_income(spark, sf_dir):
    star = star_of(spark, sf_dir)
    joined = K.join_income(K.join_county(star.cases, star), star)
    return joined.select(KEY, F.col("county_name").alias("county"), F.round("median_household_income", 6).alias("income"))


@query(
    "join_judge",
    f"{WITH_CASES} SELECT internal_case_id, s_name AS judge_name FROM cases JOIN supplier ON judge_id = s_suppkey",
)
def join_judge(spark, sf_dir):
    star = star_of(spark, sf_dir)
    return K.join_judge(star.cases, star).select(KEY, "judge_name")


@query(
    "join_existence",
    f"""{WITH_CASES} SELECT internal_case_id, district_id, court_id, representation_id FROM cases
 WHERE district_id IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 4)
  AND court_id IN (SELECT p_brand FROM part) AND representation_id IN (SELECT n_nationkey FROM nation)""",
)
def join_existence(spark, sf_dir):
    """One district is left out of the dimension, so that some references are unknown."""
    star = star_of(spark, sf_dir)
    known = type(star)(**{**star.__dict__, "districts": star.districts.filter(F.col("district_uuid") != 4)})
    return K.with_known_references(star.cases, known).select(KEY, "district_id", "court_id", "representation_id")


COHORT_BY_COUNTY = f"""{WITH_BASE}
SELECT county_name, count(*) AS n, count(DISTINCT judge_name) AS judges,
 {r(exact_mean('first_bail_set_cash'))} AS avg_bail,
 {r('max(median_household_income)')} AS income,
 {r(f"corr({number('prior_misd_cnt')}, {number('first_bail_set_cash')})")} AS corr_misd
FROM base GROUP BY county_name"""


@query("cohort_by_county", COHORT_BY_COUNTY)
def cohort_by_county(spark, sf_dir):
    """Flagship: the whole cohort query, summarised per county."""
    return R.county_overview(cohort_of(spark, sf_dir))


@query(
    "base_cohort",
    f"{WITH_BASE} SELECT * REPLACE (round(median_household_income, 6) AS median_household_income) FROM base",
)
def base_cohort(spark, sf_dir):
    return _rounded_income(cohort_of(spark, sf_dir))

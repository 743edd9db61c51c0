"""Summaries, star loading and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelstat.functions.columns import rounded
from gavelstat.operators import quality as Q
from gavelstat.operators import rollups as R
from gavelstat.operators import star_load as L
from gavelstat.plans.catalog import (
    INCOME,
    KEY,
    RACES,
    WITH_BASE,
    WITH_CASES,
    bin_sql,
    cohort_of,
    exact_mean,
    number,
    query,
    r,
    severity,
    star_of,
)
from gavelstat.schema import FEATURES, TEXT_NUMBERS
from gavelstat.sources.tpch_star import table
from gavelstat.workspace import materialize

BAIL = number("first_bail_set_cash")
MEAN = exact_mean("first_bail_set_cash")
DAYS = number("known_days_in_custody")


def _round(df, *columns):
    return df.withColumns({c: rounded(F.col(c)) for c in columns})


@query("average_target", f"{WITH_BASE} SELECT {r(MEAN)} AS average_bail_amount FROM base")
def average_target(spark, sf_dir):
    return _round(R.average_target(cohort_of(spark, sf_dir)), "average_bail_amount")


@query("case_totals", f"{WITH_BASE} SELECT count(*) AS total_cases, CAST({len(FEATURES)} AS INT) AS num_features FROM base")
def case_totals(spark, sf_dir):
    cohort = cohort_of(spark, sf_dir)
    return R.case_totals(cohort, len([c for c in cohort.columns if c in FEATURES]))


def _sorted(column):
    return f"list_sort(list(DISTINCT {column}) FILTER ({column} IS NOT NULL))"


def _yes(column):
    return f"count(*) FILTER ({column} = 'Y')"


@query(
    "rollup_judge",
    f"""{WITH_CASES} SELECT s_name AS judge_name, {r(MEAN)} AS average_bail_set, count(*) AS case_count,
 {_sorted('r_name')} AS unique_districts, {_sorted('n.n_name')} AS counties, {_sorted('court_id')} AS court_names,
 {_sorted('rep.n_name')} AS representation_types, {_sorted('top_charge_at_arraign')} AS top_charges_at_arraign,
 coalesce({_sorted('disposition_type')}, []) AS disposition_types,
 {_sorted('pretrial_supervision_at_arraign')} AS supervision_conditions,
 {_sorted('arraign_charge_category')} AS offense_types,
 {_yes('remanded_to_jail_at_arraign')} AS remand_to_jail_count, {_yes('ror_at_arraign')} AS ror_count,
 {_yes('bail_set_and_posted_at_arraign')} AS bail_set_and_posted_count,
 {_yes('bail_set_and_not_posted_at_arraign')} AS bail_set_and_not_posted_count,
 {r(f"avg(CASE WHEN top_charge_weight_at_conviction IS NOT NULL THEN {severity('top_charge_weight_at_conviction')} END)")}
  AS average_sentence_severity,
 {r("avg(CASE WHEN rearrest = 'Y' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS rearrest_rate
 FROM cases JOIN supplier ON judge_id = s_suppkey JOIN region ON district_id = r_regionkey
  JOIN nation n ON county_id = n.n_nationkey JOIN nation rep ON representation_id = rep.n_nationkey
 GROUP BY s_name""",
)
def rollup_judge(spark, sf_dir):
    return _round(
        R.rollup_judge(star_of(spark, sf_dir)), "average_bail_set", "average_sentence_severity", "rearrest_rate"
    )


@query(
    "rollup_court",
    f"""{WITH_CASES} SELECT court_id AS court_name, {r(MEAN)} AS average_bail_amount,
 count(*) AS number_of_cases FROM cases GROUP BY court_id""",
)
def rollup_court(spark, sf_dir):
    return _round(R.rollup_court(star_of(spark, sf_dir)), "average_bail_amount")


@query(
    "rollup_charge",
    f"""{WITH_CASES} SELECT crime_id AS top_charge_at_arrest, {r(MEAN)} AS average_bail_amount,
 count(*) AS number_of_cases FROM cases GROUP BY crime_id""",
)
def rollup_charge(spark, sf_dir):
    return _round(R.rollup_charge(star_of(spark, sf_dir)), "average_bail_amount")


def _percent(condition):
    return r(f"100.0::DOUBLE * avg(CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")


OUTCOMES = f"""{r(MEAN)} AS average_bail_amount, count(*) AS number_of_cases,
 {r(f'avg({DAYS})')} AS average_known_days_in_custody,
 {_percent("remanded_to_jail_at_arraign = 'Y'")} AS remanded_percentage,
 {_percent("bail_set_and_posted_at_arraign = 'Y' OR bail_set_and_not_posted_at_arraign = 'Y'")} AS bail_set_percentage,
 {_percent("disposition_type IS NOT NULL")} AS disposed_at_arraign_percentage,
 {_percent("ror_at_arraign = 'Y'")} AS ror_percentage,
 {_percent("nmr_at_arraign = 'Y'")} AS nonmonetary_release_percentage"""
OUTCOME_COLUMNS = [
    "average_bail_amount",
    "average_known_days_in_custody",
    "remanded_percentage",
    "bail_set_percentage",
    "disposed_at_arraign_percentage",
    "ror_percentage",
    "nonmonetary_release_percentage",
]


@query("rollup_race", f"{WITH_CASES} SELECT race_id AS race, {OUTCOMES} FROM cases GROUP BY race_id")
def rollup_race(spark, sf_dir):
    return _round(R.rollup_race(star_of(spark, sf_dir)), *OUTCOME_COLUMNS)


@query(
    "rollup_representation",
    f"""{WITH_CASES} SELECT n_name AS representation_type, {OUTCOMES} FROM cases
 JOIN nation ON representation_id = n_nationkey GROUP BY n_name""",
)
def rollup_representation(spark, sf_dir):
    return _round(R.rollup_representation(star_of(spark, sf_dir)), *OUTCOME_COLUMNS)


@query(
    "rollup_county",
    f"""{WITH_CASES}, {INCOME}, per AS (SELECT n_name AS county_name, {r(MEAN)} AS average_bail_amount,
  count(*) AS number_of_cases FROM cases JOIN nation ON county_id = n_nationkey GROUP BY n_name)
 SELECT per.*, {r('median_household_income')} AS median_income FROM per LEFT JOIN ny_income ON county = county_name""",
)
def rollup_county(spark, sf_dir):
    return _round(R.rollup_county(star_of(spark, sf_dir)), "average_bail_amount", "median_income")


@query(
    "rollup_all_levels",
    f"""{WITH_BASE} SELECT county_name, judge_name, {r(MEAN)} AS average_bail_amount,
 count(*) AS number_of_cases,
 CASE GROUPING(county_name, judge_name) WHEN 3 THEN 'state' WHEN 1 THEN 'county' ELSE 'judge' END AS level
 FROM base GROUP BY GROUPING SETS ((), (county_name), (county_name, judge_name))""",
)
def rollup_all_levels(spark, sf_dir):
    return _round(R.rollup_all_levels(cohort_of(spark, sf_dir)), "average_bail_amount")


@query(
    "target_vs_disposition",
    f"""{WITH_CASES}, amounts AS (SELECT disposition_type, first_bail_set_cash, {BAIL} AS b FROM cases WHERE {BAIL} IS NOT NULL)
 SELECT disposition_type, {bin_sql('b', 'lo', 'hi', 10)} AS bin, count(*) AS n, {r(MEAN)} AS average_bail_amount
 FROM amounts, (SELECT min(b) AS lo, max(b) AS hi FROM amounts) GROUP BY ALL""",
)
def target_vs_disposition(spark, sf_dir):
    return _round(R.target_by_disposition(star_of(spark, sf_dir).cases), "average_bail_amount")


def _uuid(text):
    parts = ", ".join(f"substr(md5({text}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"concat_ws('-', {parts})"


FLAT = [
    L.DimensionSpec("races", "race_id", ["race"]),
    L.DimensionSpec("counties", "county_id", ["county_name"], ["median_household_income"]),
    L.DimensionSpec("judges", "judge_id", ["judge_name"]),
]


@query(
    "normalize_flat",
    f"""{WITH_BASE} SELECT b.internal_case_id, {BAIL} AS bail_amount, r.race, c.county_name, j.judge_name,
  {r('c.income')} AS income, r.id AS race_id, c.id AS county_id, j.id AS judge_id FROM base b
 JOIN (SELECT race, {_uuid('race')} AS id FROM base GROUP BY race) r ON b.race = r.race
 JOIN (SELECT county_name, min(median_household_income) AS income, {_uuid('county_name')} AS id FROM base
  GROUP BY county_name) c ON b.county_name = c.county_name
 JOIN (SELECT judge_name, {_uuid('judge_name')} AS id FROM base GROUP BY judge_name) j ON b.judge_name = j.judge_name""",
)
def normalize_flat(spark, sf_dir):
    """Flat cohort to star; joining the star again gives the flat records back."""
    flat = materialize(cohort_of(spark, sf_dir), "flat")
    fact, dims = L.normalize_flat(flat, FLAT)
    joined = fact
    for spec in FLAT:
        d = dims[spec.name]
        joined = joined.join(d, F.col(spec.foreign_key) == F.col(f"{spec.name}_uuid"))
    return joined.select(
        KEY, "bail_amount", "race", "county_name", "judge_name", rounded(F.col("median_household_income")).alias("income"),
        "race_id", "county_id", "judge_id",
    )


@query(
    "surrogate_key",
    f"{WITH_CASES} SELECT internal_case_id, {_uuid('internal_case_id')} AS case_uuid FROM cases",
)
def surrogate_key(spark, sf_dir):
    return L.add_surrogate_key(star_of(spark, sf_dir).cases.select(KEY), [KEY], "case_uuid")


@query(
    "dq_duplicate_keys",
    f"""{WITH_CASES} SELECT 'case' AS key_name, internal_case_id AS key_value, count(*) AS n FROM cases
  GROUP BY internal_case_id HAVING count(*) > 1
 UNION ALL SELECT 'order and line', concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)), count(*)
  FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
 UNION ALL SELECT 'judge', s_name, count(*) FROM supplier GROUP BY s_name HAVING count(*) > 1""",
)
def dq_duplicate_keys(spark, sf_dir):
    star = star_of(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem")
    composite = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    checks = [
        ("case", Q.duplicate_keys(star.cases, [KEY]), F.col(KEY)),
        ("order and line", Q.duplicate_keys(lines, ["l_orderkey", "l_linenumber"]), composite),
        ("judge", Q.duplicate_keys(star.judges, ["judge_name"]), F.col("judge_name")),
    ]
    parts = [d.select(F.lit(n).alias("key_name"), v.alias("key_value"), "n") for n, d, v in checks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "dq_unique_keys",
    f"""{WITH_CASES}, {INCOME}, {RACES} SELECT 'cases' AS table_name, count(*) AS violations FROM
  (SELECT 1 FROM cases GROUP BY internal_case_id HAVING count(*) > 1)
 UNION ALL SELECT 'judges', count(*) FROM (SELECT 1 FROM supplier GROUP BY s_name HAVING count(*) > 1)
 UNION ALL SELECT 'courts', 0 UNION ALL SELECT 'crimes', 0 UNION ALL SELECT 'races', 0
 UNION ALL SELECT 'representation', count(*) FROM (SELECT 1 FROM nation GROUP BY n_name HAVING count(*) > 1)
 UNION ALL SELECT 'ny_income', count(*) FROM (SELECT 1 FROM ny_income GROUP BY county HAVING count(*) > 1)
 UNION ALL SELECT 'counties', count(*) FROM (SELECT 1 FROM nation GROUP BY n_name HAVING count(*) > 1)""",
)
def dq_unique_keys(spark, sf_dir):
    return Q.duplicate_key_counts(star_of(spark, sf_dir))


@query(
    "dq_orphan_fk",
    """WITH refs AS (SELECT d.doc_id AS doc, l.doc_id AS hit FROM documents d LEFT JOIN labels l USING (doc_id))
 SELECT doc AS doc_id FROM refs WHERE hit IS NULL""",
)
def dq_orphan_fk(spark, sf_dir):
    """Documents without a label row stand in for references without a target."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return Q.orphans(docs, "doc_id", table(spark, sf_dir, "labels"), "doc_id")


@query(
    "dq_orphan_counts",
    f"""{WITH_CASES} SELECT 'race_id' AS foreign_key, count(*) AS violations FROM cases
  WHERE race_id NOT IN (SELECT c_mktsegment FROM customer)
 UNION ALL SELECT 'court_id', count(*) FROM cases WHERE court_id NOT IN (SELECT p_brand FROM part)
 UNION ALL SELECT 'county_id', count(*) FROM cases WHERE county_id NOT IN (SELECT n_nationkey FROM nation)
 UNION ALL SELECT 'top_charge_id', count(*) FROM cases WHERE top_charge_id NOT IN (SELECT p_type FROM part)
 UNION ALL SELECT 'crime_id', count(*) FROM cases WHERE crime_id NOT IN (SELECT p_type FROM part)
 UNION ALL SELECT 'representation_id', count(*) FROM cases WHERE representation_id NOT IN (SELECT n_nationkey FROM nation)
 UNION ALL SELECT 'judge_id', count(*) FROM cases WHERE judge_id NOT IN (SELECT s_suppkey FROM supplier)
 UNION ALL SELECT 'district_id', count(*) FROM cases WHERE district_id NOT IN
  (SELECT r_regionkey FROM region WHERE r_regionkey <> 4)""",
)
def dq_orphan_counts(spark, sf_dir):
    """One district is left out of the dimension, so its cases are orphans."""
    star = star_of(spark, sf_dir)
    known = type(star)(**{**star.__dict__, "districts": star.districts.filter(F.col("district_uuid") != 4)})
    return Q.orphan_counts(known)


NULL_CHECKED = ["internal_case_id", "ethnicity", "age_at_arrest", "first_bail_set_cash",
                "top_charge_weight_at_arraign", "prior_misd_cnt", "disposition_type"]


@query(
    "dq_not_null",
    f"{WITH_CASES} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS violations FROM cases" for c in NULL_CHECKED
    ),
)
def dq_not_null(spark, sf_dir):
    return Q.null_counts(star_of(spark, sf_dir).cases, NULL_CHECKED)


@query(
    "dq_enum_domain",
    """SELECT event_type, count(*) AS n FROM events
 WHERE event_type IS NOT NULL AND event_type NOT IN ('view', 'click') GROUP BY event_type""",
)
def dq_enum_domain(spark, sf_dir):
    return Q.out_of_domain(table(spark, sf_dir, "events"), "event_type", ["view", "click"])


def _text_number_sql(c):
    return (
        f"SELECT '{c}' AS column_name, count({c}) AS n_values, "
        f"count(*) FILTER ({c} IS NOT NULL AND ({number(c)}) IS NULL) AS n_bad FROM cases"
    )


@query(
    "dq_text_numeric",
    f"""{WITH_CASES} SELECT *, {r('n_bad / nullif(n_values, 0)')} AS bad_share FROM (
 {' UNION ALL '.join(_text_number_sql(c) for c in [*TEXT_NUMBERS, 'first_bail_set_cash'])})""",
)
def dq_text_numeric(spark, sf_dir):
    return _round(Q.unparsable_numbers(star_of(spark, sf_dir).cases), "bad_share")

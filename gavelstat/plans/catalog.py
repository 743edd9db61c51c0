"""Registry of queries, shared inputs and the shared parts of the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gavelstat.operators import cohort as K
from gavelstat.schema import FEATURES, SEVERITY, SEVERITY_WEIGHTS, Star
from gavelstat.sources.tpch_star import bind_star

KEY = "internal_case_id"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where one exists, its SQL twin."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def star_of(spark: SparkSession, sf_dir: str) -> Star:
    return bind_star(spark, sf_dir)


def cohort_of(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return K.base_cohort(bind_star(spark, sf_dir), keep=[KEY], **options)


# ---- shared SQL ----

CASES = """
cases AS (
 SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
   CAST(l_suppkey AS VARCHAR)) AS internal_case_id,
  l_linestatus AS gender,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS ethnicity,
  CASE WHEN p_size <> 50 THEN p_size END AS age_at_arrest,
  CAST(date_diff('day', o_orderdate, l_shipdate) AS VARCHAR) AS known_days_in_custody,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'AF' WHEN '2-HIGH' THEN 'CF' WHEN '3-MEDIUM' THEN 'EF'
   WHEN '5-LOW' THEN 'UM' END AS top_charge_weight_at_arraign,
  CASE WHEN l_linenumber = 7 THEN 'N/A' WHEN l_linenumber = 6 AND l_returnflag = 'N' THEN NULL
   ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS first_bail_set_cash,
  CAST(l_linenumber AS VARCHAR) AS prior_vfo_cnt,
  CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) AS prior_nonvfo_cnt,
  CASE WHEN l_quantity <> 13 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS prior_misd_cnt,
  CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR) AS pend_nonvfo,
  CAST(p_size % 10 AS VARCHAR) AS pend_misd,
  CAST(month(o_orderdate) AS VARCHAR) AS pend_vfo,
  CASE WHEN l_linenumber = 1 THEN 'Y' ELSE 'N' END AS remanded_to_jail_at_arraign,
  CASE WHEN l_linenumber = 2 THEN 'Y' ELSE 'N' END AS ror_at_arraign,
  CASE WHEN l_linenumber = 3 THEN 'Y' ELSE 'N' END AS nmr_at_arraign,
  CASE WHEN l_linenumber IN (4, 5) THEN 'Y' ELSE 'N' END AS bail_set_and_posted_at_arraign,
  CASE WHEN l_linenumber IN (6, 7) THEN 'Y' ELSE 'N' END AS bail_set_and_not_posted_at_arraign,
  CASE l_returnflag WHEN 'A' THEN 'Dismissed' WHEN 'R' THEN 'Convicted' END AS disposition_type,
  CASE WHEN l_tax > 0.055 THEN 'Y' ELSE 'N' END AS rearrest,
  CASE WHEN l_returnflag = 'R' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'AF' WHEN '2-HIGH' THEN 'CF'
   WHEN '3-MEDIUM' THEN 'EF' WHEN '5-LOW' THEN 'UM' END END AS top_charge_weight_at_conviction,
  concat_ws(' ', l_returnflag, l_linestatus) AS pretrial_supervision_at_arraign,
  c_mktsegment AS arraign_charge_category, p_type AS top_charge_at_arraign,
  c_mktsegment AS race_id, s_nationkey AS county_id, l_suppkey AS judge_id, n_regionkey AS district_id,
  p_brand AS court_id, c_nationkey AS representation_id, p_type AS top_charge_id, p_type AS crime_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""

INCOME = """
ny_income AS (
 SELECT c_nationkey AS income_uuid, n_name AS county,
  CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS median_household_income
 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""

RACES = "races AS (SELECT DISTINCT c_mktsegment AS race_uuid, c_mktsegment AS race FROM customer)"


def number(column: str) -> str:
    """SQL for a text number, NULL where it does not parse."""
    pattern = r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*"
    return f"CASE WHEN regexp_full_match({column}, '{pattern}') THEN TRY_CAST(trim({column}) AS DOUBLE) END"


def exact_mean(column: str) -> str:
    """SQL for the plain mean of a text amount."""
    return f"avg({number(column)})"


def r(expression: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0"


ELIGIBLE = """first_bail_set_cash IS NOT NULL AND top_charge_weight_at_arraign IS NOT NULL
   AND TRY_CAST(first_bail_set_cash AS DOUBLE) < 39000
   AND TRY_CAST(first_bail_set_cash AS DOUBLE) > 1
   AND TRY_CAST(known_days_in_custody AS DOUBLE) < 100"""

COHORT_LIST = """gender, ethnicity, race, age_at_arrest, known_days_in_custody, top_charge_weight_at_arraign,
  first_bail_set_cash, prior_vfo_cnt, prior_nonvfo_cnt, prior_misd_cnt, pend_nonvfo, pend_misd, pend_vfo,
  county_name, judge_name, median_household_income"""

JOINED = f"""
joined AS (
 SELECT c.*, race, n_name AS county_name, s_name AS judge_name, median_household_income
 FROM cases c JOIN races ON race_id = race_uuid JOIN nation ON county_id = n_nationkey
  JOIN ny_income ON n_name = county JOIN supplier ON judge_id = s_suppkey
  JOIN region ON district_id = r_regionkey
  JOIN (SELECT DISTINCT p_brand FROM part) courts ON court_id = courts.p_brand
  JOIN (SELECT n_nationkey AS rep FROM nation) ON representation_id = rep)"""

BASE = f"""
base AS (SELECT {COHORT_LIST}, internal_case_id FROM joined WHERE {ELIGIBLE})"""

WITH_CASES = f"WITH {CASES}"
WITH_JOINED = f"WITH {CASES}, {INCOME}, {RACES}, {JOINED}"
WITH_BASE = f"WITH {CASES}, {INCOME}, {RACES}, {JOINED}, {BASE}"

CAPPED = f"""
parsed AS (SELECT * EXCLUDE (first_bail_set_cash), {number('first_bail_set_cash')} AS bail_amount FROM base),
capped AS (SELECT * FROM parsed WHERE bail_amount <= (SELECT quantile_cont(bail_amount, 0.99) FROM parsed))"""
WITH_CAPPED = f"{WITH_BASE}, {CAPPED}"

NUMERIC = ["age_at_arrest", "median_household_income"]
CATEGORICAL = [f for f in FEATURES if f not in NUMERIC]
SCALED = ["median_household_income", "known_days_in_custody", "age_at_arrest", "prior_misd_cnt", "prior_nonvfo_cnt"]


def severity(column: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_WEIGHTS.items())
    return f"CAST(CASE {column} {whens} ELSE 0 END AS DOUBLE)"


def mode_of(column: str, table: str) -> str:
    return (
        f"(SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} "
        f"ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


def _prepared() -> str:
    numbers = [f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM capped)) AS {c}" for c in NUMERIC]
    labels = [f"coalesce({c}, {mode_of(c, 'capped')}) AS {c}" for c in CATEGORICAL]
    coded = [
        f"{severity(c)} AS {c}" if c == SEVERITY
        else f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}"
        for c in CATEGORICAL
    ]
    scaled = [
        f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}" if c in SCALED else c
        for c in FEATURES
    ]
    return f""",
filled AS (SELECT internal_case_id, bail_amount, {', '.join(numbers + labels)} FROM capped),
coded AS (SELECT internal_case_id, bail_amount, {', '.join(NUMERIC + coded)} FROM filled),
prepared AS (SELECT internal_case_id, bail_amount / max(bail_amount) OVER () AS bail_amount,
 {', '.join(scaled)} FROM coded)"""


WITH_PREPARED = WITH_CAPPED + _prepared()
WITH_CODED = WITH_PREPARED


def bin_sql(value: str, low: str, high: str, bins: int) -> str:
    """Edge-counting interval number; the step is computed once, as on the Spark side."""
    step = f"(({high} - {low}) / {bins})"
    return " + ".join(f"CAST({value} > {i} * {step} + {low} AS INT)" for i in range(1, bins))


def split_ctes(source: str, target: str = "bail_amount", bins: int = 20, seed: int = 42) -> str:
    """Stratified split of ``source`` by ranks of the key's md5 within equal-width target strata."""
    return f""",
stratified AS (SELECT s.*, {bin_sql(target, 'lo', 'hi', bins)} AS stratum FROM {source} s,
 (SELECT min({target}) AS lo, max({target}) AS hi FROM {source})),
strata AS (SELECT stratum, count(*) AS c FROM stratified GROUP BY stratum),
total AS (SELECT sum(c) AS n, CAST(ceil(CAST(sum(c) AS DOUBLE) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS t FROM strata),
shares AS (SELECT stratum, (c * t) // n AS base_share, (c * t) % n AS rest, t FROM strata, total),
allotted AS (SELECT stratum, base_share + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum)
  <= t - sum(base_share) OVER () THEN 1 ELSE 0 END AS n_test FROM shares),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('{seed}:' || internal_case_id),
  internal_case_id) AS rank_in_stratum FROM stratified),
parts AS (SELECT ranked.* EXCLUDE (rank_in_stratum),
  CASE WHEN rank_in_stratum <= n_test THEN 'test' ELSE 'train' END AS split
 FROM ranked JOIN allotted USING (stratum))"""

"""Cleaning, encoding, scaling, binning and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelstat.functions.columns import rounded
from gavelstat.operators import prepare as P
from gavelstat.operators.split import stratified_split
from gavelstat.plans.catalog import (
    CATEGORICAL,
    KEY,
    NUMERIC,
    WITH_BASE,
    WITH_CAPPED,
    WITH_CASES,
    WITH_PREPARED,
    bin_sql,
    cohort_of,
    mode_of,
    number,
    query,
    r,
    severity,
    split_ctes,
    star_of,
)
from gavelstat.schema import FEATURES, SEVERITY, TARGET
from gavelstat.sources.tpch_star import table
from gavelstat.workspace import materialize


def stored_cohort(spark, sf_dir):
    """The cohort written once, for operators that read it several times."""
    return materialize(cohort_of(spark, sf_dir), "cohort")


def _capped(spark, sf_dir):
    return P.quantile_cap(P.coerce_target(stored_cohort(spark, sf_dir)))


def labelled_documents(spark, sf_dir):
    """Documents with their optional labels: real missing values."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


DOCS = "documents d LEFT JOIN labels USING (doc_id)"


@query(
    "to_numeric",
    f"{WITH_CASES} SELECT internal_case_id, {number('first_bail_set_cash')} AS bail_amount FROM cases",
)
def to_numeric(spark, sf_dir):
    return P.coerce_target(star_of(spark, sf_dir).cases).select(KEY, TARGET)


@query("quantile_cap", f"{WITH_CAPPED} SELECT internal_case_id, bail_amount FROM capped")
def quantile_cap(spark, sf_dir):
    return _capped(spark, sf_dir).select(KEY, TARGET)


@query(
    "drop_all_null_rows",
    f"SELECT doc_id, quality, toxic FROM {DOCS} WHERE quality IS NOT NULL OR toxic IS NOT NULL",
)
def drop_all_null_rows(spark, sf_dir):
    return P.drop_all_null_rows(labelled_documents(spark, sf_dir), ["quality", "toxic"]).select(
        "doc_id", "quality", "toxic"
    )


@query("drop_array_columns", "SELECT vec_id, label FROM embeddings")
def drop_array_columns(spark, sf_dir):
    return P.drop_array_columns(table(spark, sf_dir, "embeddings"))


@query(
    "impute_target_median",
    f"""{WITH_CASES}, parsed AS (SELECT internal_case_id, {number('first_bail_set_cash')} AS b FROM cases)
 SELECT internal_case_id, {r('coalesce(b, (SELECT median(b) FROM parsed))')} AS bail_amount FROM parsed""",
)
def impute_target_median(spark, sf_dir):
    parsed = materialize(P.coerce_target(star_of(spark, sf_dir).cases).select(KEY, TARGET), "target")
    filled = P.impute_median(parsed, [TARGET])
    return filled.select(KEY, rounded(F.col(TARGET)).alias(TARGET))


@query(
    "impute_numeric_median",
    f"""WITH docs AS (SELECT doc_id, n_chars, quality, toxic FROM {DOCS})
 SELECT doc_id, {r('coalesce(n_chars, (SELECT median(n_chars) FROM docs))')} AS n_chars,
  {r('coalesce(quality, (SELECT median(quality) FROM docs))')} AS quality,
  {r('coalesce(toxic, (SELECT median(toxic) FROM docs))')} AS toxic FROM docs""",
)
def impute_numeric_median(spark, sf_dir):
    docs = materialize(labelled_documents(spark, sf_dir), "documents")
    filled = P.impute_median(docs, ["n_chars", "quality", "toxic"])
    return filled.select("doc_id", *[rounded(F.col(c)).alias(c) for c in ("n_chars", "quality", "toxic")])


@query(
    "impute_mode",
    f"""{WITH_BASE} SELECT internal_case_id, coalesce(ethnicity, {mode_of('ethnicity', 'base')}) AS ethnicity,
  coalesce(prior_misd_cnt, {mode_of('prior_misd_cnt', 'base')}) AS prior_misd_cnt FROM base""",
)
def impute_mode(spark, sf_dir):
    columns = ["ethnicity", "prior_misd_cnt"]
    return P.impute_mode(stored_cohort(spark, sf_dir), columns).select(KEY, *columns)


@query(
    "dtype_partition",
    f"""{WITH_BASE} SELECT {', '.join(f'count({c}) AS {c}' for c in NUMERIC + CATEGORICAL)},
 '{','.join(NUMERIC + CATEGORICAL)}' AS column_order FROM base""",
)
def dtype_partition(spark, sf_dir):
    """Present values per column, in the order numeric first, then the others."""
    split = P.partition_by_type(cohort_of(spark, sf_dir).drop("first_bail_set_cash"), keep=[KEY]).drop(KEY)
    counted = split.agg(*[F.count(c).alias(c) for c in split.columns])
    return counted.withColumn("column_order", F.lit(",".join(split.columns)))


@query("severity_map", f"{WITH_BASE} SELECT internal_case_id, {severity(SEVERITY)} AS {SEVERITY} FROM base")
def severity_map(spark, sf_dir):
    return P.map_severity(cohort_of(spark, sf_dir)).select(KEY, SEVERITY)


ENCODED = ["gender", "race", "prior_vfo_cnt", "prior_nonvfo_cnt", "pend_misd", "county_name", "judge_name",
           "known_days_in_custody"]


@query(
    "label_encode",
    f"{WITH_BASE} SELECT internal_case_id, "
    + ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}" for c in ENCODED)
    + " FROM base",
)
def label_encode(spark, sf_dir):
    return P.label_encode(stored_cohort(spark, sf_dir), ENCODED).select(KEY, *ENCODED)


@query(
    "label_encode_new",
    f"""{WITH_CASES}, fitted AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM
  (SELECT DISTINCT prior_misd_cnt AS v FROM cases WHERE district_id IN (0, 1) AND prior_misd_cnt IS NOT NULL)),
 own AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM
  (SELECT DISTINCT court_id AS v FROM cases WHERE district_id NOT IN (0, 1))),
 fresh AS (SELECT * FROM cases WHERE district_id NOT IN (0, 1))
 SELECT internal_case_id,
  {r('coalesce(age_at_arrest, (SELECT median(age_at_arrest) FROM fresh))')} AS age_at_arrest,
  {r('''coalesce(f.code, (SELECT median(g.code) FROM fresh h JOIN fitted g ON h.prior_misd_cnt = g.v))''')}
   AS prior_misd_cnt,
  {r('own.code')} AS court_id
 FROM fresh LEFT JOIN fitted f ON prior_misd_cnt = f.v LEFT JOIN own ON court_id = own.v""",
)
def label_encode_new(spark, sf_dir):
    """Encoders fitted on two districts, applied to the others; courts have none yet."""
    cases = star_of(spark, sf_dir).cases.select(KEY, "district_id", "age_at_arrest", "prior_misd_cnt", "court_id")
    cases = materialize(cases, "cases")
    known = F.col("district_id").isin(0, 1)
    encoder = P.fit_labels(cases.filter(known), ["prior_misd_cnt"])
    new = cases.filter(~known).drop("district_id")
    coded = P.label_encode_new(new, encoder, ["prior_misd_cnt", "court_id"])
    return coded.select(KEY, *[rounded(F.col(c)).alias(c) for c in ("age_at_arrest", "prior_misd_cnt", "court_id")])


@query(
    "one_hot",
    f"{WITH_BASE} SELECT internal_case_id, "
    + ", ".join(
        f"CAST(race = '{s}' AS INT) AS \"race_{s}\""
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM base",
)
def one_hot(spark, sf_dir):
    return P.one_hot(cohort_of(spark, sf_dir).select(KEY, "race"), "race")


@query(
    "standardize",
    f"""{WITH_BASE} SELECT internal_case_id,
 {r('(age_at_arrest - avg(age_at_arrest) OVER ()) / stddev_pop(age_at_arrest) OVER ()')} AS age_at_arrest,
 {r('(median_household_income - avg(median_household_income) OVER ()) / stddev_pop(median_household_income) OVER ()')}
  AS median_household_income FROM base""",
)
def standardize(spark, sf_dir):
    scaled = P.standardize(stored_cohort(spark, sf_dir).select(KEY, *NUMERIC))
    return scaled.select(KEY, *[rounded(F.col(c)).alias(c) for c in NUMERIC])


@query(
    "scale_max",
    f"{WITH_CAPPED} SELECT internal_case_id, {r('bail_amount / max(bail_amount) OVER ()', 9)} AS bail_amount FROM capped",
)
def scale_max(spark, sf_dir):
    return P.scale_by_max(_capped(spark, sf_dir)).select(KEY, rounded(F.col(TARGET), 9).alias(TARGET))


def _bins_sql(bins):
    return f"""{WITH_CAPPED} SELECT bin, count(*) AS n FROM (
 SELECT {bin_sql('bail_amount', 'lo', 'hi', bins)} AS bin FROM capped,
  (SELECT min(bail_amount) AS lo, max(bail_amount) AS hi FROM capped)) GROUP BY bin"""


@query("equal_width_bin", _bins_sql(20))
def equal_width_bin(spark, sf_dir):
    return P.value_counts(P.bin_column(_capped(spark, sf_dir), TARGET, 20), "bin")


_CANDIDATES = " UNION ALL ".join(
    f"SELECT {n} AS bins, {bin_sql('amount', 'lo', 'hi', n)} AS bin, count(*) AS n FROM cubed, lim GROUP BY ALL"
    for n in range(10, 1, -1)
)


@query(
    "adaptive_bin",
    f"""WITH spent AS (SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS cents
  FROM events GROUP BY user_id),
 cubed AS (SELECT cents * cents * cents AS amount FROM spent),
 lim AS (SELECT min(amount) AS lo, max(amount) AS hi FROM cubed),
 tried AS ({_CANDIDATES}),
 best AS (SELECT max(bins) AS bins FROM (SELECT bins FROM tried GROUP BY bins HAVING min(n) >= 2))
 SELECT t.bins, t.bin, t.n FROM tried t JOIN best USING (bins)""",
)
def adaptive_bin(spark, sf_dir):
    """Heavy-tailed spending per user: the first bin counts leave thin intervals."""
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double").alias("cents")
    spent = table(spark, sf_dir, "events").groupBy("user_id").agg(cents)
    cubed = materialize(spent.select((F.col("cents") * F.col("cents") * F.col("cents")).alias("amount")), "spent")
    return P.adaptive_bin(cubed, "amount").groupBy("bins", "bin").agg(F.count("*").alias("n"))


@query("value_counts", f"{WITH_BASE} SELECT {SEVERITY}, count(*) AS n FROM base GROUP BY {SEVERITY}")
def value_counts(spark, sf_dir):
    return P.value_counts(cohort_of(spark, sf_dir), SEVERITY)


@query(
    "split_xy",
    f"""{WITH_CAPPED} SELECT internal_case_id, race, county_name, {bin_sql('bail_amount', 'lo', 'hi', 10)} AS bail_amount
 FROM capped, (SELECT min(bail_amount) AS lo, max(bail_amount) AS hi FROM capped)""",
)
def split_xy(spark, sf_dir):
    """Features and ten-interval target, put side by side again by key."""
    x, y = P.separate(materialize(_capped(spark, sf_dir), "capped"), key=[KEY], bins=10)
    return x.join(y, KEY).select(KEY, "race", "county_name", TARGET)


@query(
    "prepare_features",
    f"{WITH_PREPARED} SELECT internal_case_id, {r('bail_amount')} AS bail_amount, "
    + ", ".join(f"{r(c)} AS {c}" for c in FEATURES)
    + " FROM prepared",
)
def prepare_features(spark, sf_dir):
    prepared, learned = P.prepare(stored_cohort(spark, sf_dir), keep=[KEY])
    return prepared.select(KEY, *[rounded(F.col(c)).alias(c) for c in [TARGET, *learned.features]])


@query(
    "stratified_split",
    f"{WITH_CAPPED}{split_ctes('capped')} SELECT internal_case_id, stratum, split FROM parts",
)
def split(spark, sf_dir):
    capped = materialize(_capped(spark, sf_dir).select(KEY, TARGET), "capped")
    return stratified_split(capped, F.col(KEY)).select(KEY, "stratum", "split")

"""The base cohort: predicates, dimension joins and optional group filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstat.functions.codes import BROADCAST_BYTES, BROADCAST_LABELS
from gavelstat.functions.columns import above, below, row_hash
from gavelstat.functions.order_stats import select_ranks
from gavelstat.schema import (
    AMOUNT_FLOOR,
    AMOUNT_LIMIT,
    COHORT_COLUMNS,
    DAYS_LIMIT,
    MIN_CASES,
    RAW_TARGET,
    REQUIRED_COLUMNS,
    SEVERITY,
    TARGET,
    Star,
)


def require_columns(df: DataFrame, columns: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Fail while planning if a column is missing."""
    for name in columns:
        if name not in df.columns:
            raise ValueError(f"required column {name!r} is missing; found {df.columns}")
    return df


def with_recorded_amount(cases: DataFrame) -> DataFrame:
    """Rows with an amount and a severity code."""
    return cases.filter(F.col(RAW_TARGET).isNotNull() & F.col(SEVERITY).isNotNull())


def amount_in_range(
    cases: DataFrame, low: float = AMOUNT_FLOOR, high: float = AMOUNT_LIMIT, strict: bool = False
) -> DataFrame:
    """Rows whose amount lies strictly between the limits.

    Where the amount is also stored as a number the predicate uses that, and reaches the scan.
    """
    if TARGET in cases.columns:
        return cases.filter((F.col(TARGET) < high) & (F.col(TARGET) > low))
    raw = F.col(RAW_TARGET)
    return cases.filter(below(raw, high, strict) & above(raw, low, strict))


def days_below(cases: DataFrame, limit: float = DAYS_LIMIT, strict: bool = False) -> DataFrame:
    """Rows with fewer days in custody than ``limit``."""
    return cases.filter(below(F.col("known_days_in_custody"), limit, strict))


def eligible_cases(cases: DataFrame, strict: bool = False) -> DataFrame:
    """All predicates of the base cohort."""
    return days_below(amount_in_range(with_recorded_amount(cases), strict=strict), strict=strict)


def counted(*tables: DataFrame) -> list[DataFrame]:
    """The tables, marked for broadcast where their counted rows and bytes allow it.

    Foreign keys of cases have few values, some of them very frequent: shuffled by such a key, a third of all cases
    would meet in one task.  Static estimates can't tell a small dimension made of a growing table, so all are
    counted, in one job.  A dimension beyond the bound is joined by a shuffle that adaptive execution splits.
    """
    sizes = [
        t.agg(
            F.lit(i).alias("i"), F.count("*").alias("n"),
            F.sum(F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in t.columns]))).alias("bytes"),
        )
        for i, t in enumerate(tables)
    ]
    rows = reduce(DataFrame.unionByName, sizes).collect()
    fits = {r["i"]: r["n"] <= BROADCAST_LABELS and (r["bytes"] or 0) <= BROADCAST_BYTES for r in rows}
    return [F.broadcast(t) if fits[i] else t for i, t in enumerate(tables)]


def _races(star: Star) -> DataFrame:
    return star.races.select("race_uuid", "race")


def _places(star: Star) -> DataFrame:
    """Counties with their income; those without an income row are left out."""
    income = star.ny_income.select("county", "median_household_income")
    counties = star.counties.select("county_uuid", "county_name")
    return counties.join(income, F.col("county_name") == F.col("county")).drop("county")


def _judges(star: Star) -> DataFrame:
    return star.judges.select("judge_uuid", "judge_name")


#: Keys of cases whose dimension gives no column.
REFERENCES = {"district_id": "district_uuid", "court_id": "court_uuid", "representation_id": "representation_uuid"}


def _references(star: Star) -> list[DataFrame]:
    tables = (star.districts, star.courts, star.representation)
    return [t.select(uid) for t, uid in zip(tables, REFERENCES.values())]


def _lookup(cases: DataFrame, table: DataFrame, key: str, uid: str) -> DataFrame:
    return cases.join(table, F.col(key) == F.col(uid)).drop(uid)


def join_race(cases: DataFrame, star: Star) -> DataFrame:
    return _lookup(cases, *counted(_races(star)), "race_id", "race_uuid")


def join_county(cases: DataFrame, star: Star) -> DataFrame:
    return _lookup(cases, *counted(star.counties.select("county_uuid", "county_name")), "county_id", "county_uuid")


def join_income(cases: DataFrame, star: Star) -> DataFrame:
    """Income by county name; cases of counties without an income row drop out."""
    income = star.ny_income.select("county", "median_household_income")
    return _lookup(cases, *counted(income), "county_name", "county")


def join_judge(cases: DataFrame, star: Star) -> DataFrame:
    return _lookup(cases, *counted(_judges(star)), "judge_id", "judge_uuid")


def with_known_references(cases: DataFrame, star: Star) -> DataFrame:
    """Rows whose district, court and representation exist.

    These dimensions give no column, so a semi join says all that is needed.
    """
    return _semi(cases, counted(*_references(star)))


def _semi(cases: DataFrame, tables: list[DataFrame]) -> DataFrame:
    for (key, uid), table in zip(REFERENCES.items(), tables):
        cases = cases.join(table, F.col(key) == F.col(uid), "left_semi")
    return cases


def base_cohort(
    star: Star, judge: str | None = None, county: str | None = None, strict: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """The modelling cohort; ``keep`` adds further columns, such as the row key.

    Filters come before joins.  Counties and incomes are joined with each other first, so that the cases meet one
    small table less.  An empty ``judge`` or ``county`` means no filter.
    """
    races, places, judges, *references = counted(_races(star), _places(star), _judges(star), *_references(star))
    joined = _lookup(eligible_cases(star.cases, strict), races, "race_id", "race_uuid")
    joined = _lookup(_lookup(joined, places, "county_id", "county_uuid"), judges, "judge_id", "judge_uuid")
    joined = _semi(joined, references)
    return filter_county(filter_judge(joined.select(*COHORT_COLUMNS, *keep), judge), county)


def filter_judge(cohort: DataFrame, judge: str | None) -> DataFrame:
    """One judge's cases, without the then constant name."""
    return cohort.filter(F.col("judge_name") == judge).drop("judge_name") if judge else cohort


def filter_county(cohort: DataFrame, county: str | None) -> DataFrame:
    """One county's cases, without the then constant name and income."""
    if not county:
        return cohort
    return cohort.filter(F.col("county_name") == county).drop("county_name", "median_household_income")


def restrict(
    cohort: DataFrame, judges: Sequence[str] = (), counties: Sequence[str] = (), limit: int | None = None,
    key: str = "internal_case_id", seed: int = 42,
) -> DataFrame:
    """Cases of listed judges and counties, at most ``limit`` of them; empty lists do not filter.

    The limited rows are those with the smallest key hashes.  A cutoff found by exact
    selection picks them, so a limit of millions never passes through one task.
    """
    if judges:
        cohort = cohort.filter(F.col("judge_name").isin(list(judges)))
    if counties:
        cohort = cohort.filter(F.col("county_name").isin(list(counties)))
    if limit is None:
        return cohort
    place = row_hash(F.col(key), seed)
    long = cohort.select(F.lit("rows").alias("series"), place.alias("x"))
    _, found = select_ranks(long, lambda _, n: [limit - 1] if 0 < limit < n else [])
    if limit <= 0:
        return cohort.limit(0)
    ranks = found.get("rows")
    return cohort.filter(place <= F.lit(ranks[limit - 1][0])) if ranks else cohort


def eligible_targets(dimension: DataFrame, name: str, count: str, min_cases: int = MIN_CASES) -> DataFrame:
    """Distinct names with more than ``min_cases`` cases."""
    return dimension.filter(F.col(count) > min_cases).select(name).distinct()


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, NULL included."""
    if column not in df.columns:
        raise KeyError(f"column {column!r} not found; columns are {df.columns}")
    return df.select(column).distinct()


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in key order."""
    return df.orderBy(*order_by).limit(n)

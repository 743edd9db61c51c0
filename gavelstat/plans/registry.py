"""All registered queries; importing the query modules fills the registry."""

from __future__ import annotations

from gavelstat.plans import catalog
from gavelstat.plans import (  # noqa: F401
    cohort_queries, group_queries, model_queries, prepare_queries, result_queries, rollup_queries, stump_queries,
)


def queries():
    return dict(catalog.QUERIES)


def oracle_sql():
    return dict(catalog.SQL)

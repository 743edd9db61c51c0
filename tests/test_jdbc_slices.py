"""Slices of a table read over JDBC: whole, disjoint and even, checked in an in-process SQL engine."""

import duckdb
import pytest

from gavelstat.sources.star import bounds_sql, range_predicates


@pytest.fixture
def con():
    con = duckdb.connect()
    con.sql("CREATE TABLE cases AS SELECT 'k' || i AS key FROM range(10000) t(i)")
    con.sql("INSERT INTO cases VALUES (NULL), (NULL), ('it''s'), (''), ('é'), ('Z'), ('zz'), ('k5'), ('k5')")
    return con


def counts(con, predicates):
    return [con.sql(f"SELECT count(*) FROM cases WHERE {p}").fetchall()[0][0] for p in predicates]


@pytest.mark.parametrize("slices", [1, 2, 7, 64])
def test_every_row_is_in_one_slice(con, slices):
    bounds = [b for (b,) in con.sql(bounds_sql("cases", "key", slices)).fetchall()]
    predicates = range_predicates("key", bounds)
    found = counts(con, predicates)
    assert len(predicates) == slices and sum(found) == 10_009
    assert max(found) - min(found) <= 5
    both = [f"({a}) AND ({b})" for a, b in zip(predicates, predicates[1:])]
    assert sum(counts(con, both)) == 0


def test_bounds_of_a_sample_leave_nothing_out(con):
    bounds = [b for (b,) in con.sql(bounds_sql("(SELECT * FROM cases WHERE key > 'k3') s", "key", 8)).fetchall()]
    assert sum(counts(con, range_predicates("key", bounds))) == 10_009


def test_few_keys_and_odd_texts(con):
    assert range_predicates("key", []) == ["1 = 1"] == range_predicates("key", ["a", "a"])
    assert sum(counts(con, range_predicates("key", ["", "it's", "zz"]))) == 10_009

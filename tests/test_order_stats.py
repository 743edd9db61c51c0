import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gavelstat.functions.order_stats import quantiles, select_ranks
from gavelstat.functions.ranks import descending_rank


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60), st.sampled_from([0.0, 0.05, 0.5, 0.99, 1.0]))
def test_quantile_equals_numpy(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = quantiles(df, {"v": [q]})["v"][q]
    assert got == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-9)


def test_many_columns_with_holes(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), None if b < 0 else float(b), None) for a, b in zip(rng.normal(size=3000), rng.normal(size=3000) ** 3)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = quantiles(df, {"a": [0.5], "b": [0.5, 0.9], "c": [0.5]})
    b = [r[1] for r in rows if r[1] is not None]
    assert got["a"][0.5] == pytest.approx(np.median([r[0] for r in rows]))
    assert got["b"][0.9] == pytest.approx(np.quantile(b, 0.9))
    assert got["c"][0.5] is None


def test_dominant_value_and_big_integers(spark):
    values = [2**59 + i for i in range(50)] + [2**59 + 7] * 1000
    df = spark.createDataFrame([("s", v) for v in values], "series string, x bigint")
    ordered = sorted(values)
    ranks = [0, 6, 7, 500, 1007, 1008, 1049]
    sizes, found = select_ranks(df, lambda s, n: ranks)
    assert sizes == {"s": 1050}
    assert {r: v[0] for r, v in found["s"].items()} == {r: ordered[r] for r in ranks}
    assert found["s"][500] == (2**59 + 7, 7, 1001)


def test_extreme_values(spark, monkeypatch):
    monkeypatch.setattr("gavelstat.functions.order_stats.FETCH_ROWS", 0)
    top = float("inf")
    values = sorted([-top, -top, -1.7e308, -5.0, 0.0, 1e-300, 3.0, 1.7e308, 1.75e308, top, top, top])
    df = spark.createDataFrame([("s", v) for v in values], "series string, x double")
    _, found = select_ranks(df, lambda s, n: range(n))
    assert [found["s"][r][0] for r in range(len(values))] == values
    assert found["s"][10] == (top, 9, 3)


@pytest.mark.parametrize("window_rows", [10_000, 10])
def test_descending_rank_with_ties(spark, window_rows):
    rng = np.random.default_rng(3)
    rows = [(g, None if v == 5 else float(v)) for g in ("a", "b") for v in rng.integers(0, 40, 300)]
    rows += [("a", 17.0)] * 500
    df = spark.createDataFrame(rows, "g string, v double")
    got = descending_rank(df, ["g"], F.col("v"), window_rows=window_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [x for g, x in rows if g == r["g"]]
        higher = sum(1 for x in mine if x is not None and (r["v"] is None or x > r["v"]))
        assert r["rank"] == higher + 1

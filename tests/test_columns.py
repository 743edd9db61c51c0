import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gavelstat.functions import columns as C
from gavelstat.operators import prepare as P


def test_text_numbers(spark):
    cases = {
        "1": 1.0, " 2 ": 2.0, "1e3": 1000.0, "+5": 5.0, "-.5": -0.5, "3.": 3.0, "": None, "abc": None, "1d": None,
        "1f": None, "1_000": None, "1,000": None, "$5": None, "NaN": None, "inf": None, "1e999": None, "e5": None, "1 2": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "v string")
    got = {r["v"]: r["x"] for r in df.select("v", C.to_number(F.col("v")).alias("x")).collect()}
    assert got == {**cases, None: None}


def test_strict_cast_raises(spark):
    df = spark.createDataFrame([("1.5",), ("x",)], "v string")
    assert [r[0] for r in df.select(C.below(F.col("v"), 2)).collect()] == [True, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(C.below(F.col("v"), 2, strict=True)).collect()


def test_comparisons_do_not_round(spark):
    cases = {
        "38999.99999999999": (True, True), "38999.9999999999999999999999": (True, True), "39000": (False, True),
        "39000.0000000000000000000001": (False, True), "1": (True, False), "1.0000000000000000001": (True, True),
        "0.99999999999999999999": (True, False), "-5": (True, False), "+7": (True, True), "1e25": (False, True), "-1e25": (True, False),
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = df.select("v", C.below(F.col("v"), 39000).alias("b"), C.above(F.col("v"), 1).alias("a")).collect()
    assert {r.v: (r.b, r.a) for r in got} == cases


def test_means_keep_every_amount(spark):
    for values in (["10", "1e15", "0.00004"], ["0.1"] * 10, ["1e14", "x", None, "2.123456789012345"], ["-3", "3.00001"], ["x"]):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        numbers = [float(v) for v in values if v not in ("x", None)]
        got = df.agg(C.exact_mean(F.col("v"))).first()[0]
        assert got == (pytest.approx(sum(numbers) / len(numbers), rel=1e-14) if numbers else None)


def test_severity(spark):
    df = spark.createDataFrame([("AF",), ("I",), ("??",), (None,)], "v string")
    assert [r[0] for r in df.select(C.severity_weight(F.col("v"))).collect()] == [8.0, 0.5, 0.0, 0.0]


@pytest.mark.parametrize("bins", [2, 7, 10, 20])
def test_bins_equal_pandas_cut(spark, bins):
    rng = np.random.default_rng(bins)
    on_edges = np.linspace(0.0, 1.0, bins + 1) * 0.1
    values = np.concatenate([rng.integers(0, 11, 200) / 100, on_edges[:-1], [0.1, 0.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r["bin"] for r in P.bin_column(df, "v", bins).collect()]
    assert got == pd.cut(pd.Series(values), bins=bins, labels=False).tolist()


def test_bins_of_constant_and_missing(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    assert [r["bin"] for r in P.bin_column(df, "v", 10).collect()] == [4, 4, None]


def test_surrogate_key_is_stable(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "n string, m int")
    ids = [r[0] for r in df.select(C.surrogate_key(F.col("n"), F.col("m").cast("string"))).collect()]
    assert ids[0] == ids[1] != ids[2]
    assert [len(p) for p in ids[0].split("-")] == [8, 4, 4, 4, 12]


def test_metric_names(spark):
    df = spark.createDataFrame([("a b",), ("x/y#z",), ("p-q.r_s",)], "f string")
    got = [r[0] for r in df.select(C.metric_name(F.col("f"))).collect()]
    assert got == ["importance_a b", "importance_x_y_z", "importance_p-q.r_s"]

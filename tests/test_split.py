import math

import pytest
from pyspark.sql import functions as F

from gavelstat.operators import split as S


def rows(spark, values, partitions=3):
    data = [(f"k{i}", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "k string, bail_amount double").repartition(partitions)


def as_dict(df):
    return {r["k"]: (r["stratum"], r["split"]) for r in df.collect()}


def test_shares_are_exact_and_repeatable(spark):
    values = [i % 97 for i in range(997)]
    first = as_dict(S.stratified_split(rows(spark, values, 1), F.col("k")))
    again = as_dict(S.stratified_split(rows(spark, values, 8), F.col("k")))
    assert first == again and len(first) == 997
    counts, tests = {}, {}
    for stratum, part in first.values():
        counts[stratum] = counts.get(stratum, 0) + 1
        tests[stratum] = tests.get(stratum, 0) + (part == "test")
    assert sum(tests.values()) == math.ceil(997 * 0.2)
    assert tests == S.allot(counts, math.ceil(997 * 0.2))
    assert as_dict(S.stratified_split(rows(spark, values), F.col("k"), seed=7)) != first


def test_allotment_by_largest_remainder():
    assert S.allot({0: 10, 1: 7, 2: 3}, 4) == {0: 2, 1: 1, 2: 1}
    assert S.allot({0: 5, 1: 5}, 3) == {0: 2, 1: 1}


def test_rare_strata(spark):
    values = [1.0] * 20 + [50.0] * 10 + [100.0]
    with pytest.raises(ValueError, match="single row"):
        S.stratified_split(rows(spark, values), F.col("k"), rare="error")
    merged = as_dict(S.stratified_split(rows(spark, values), F.col("k")))
    assert {s for s, _ in merged.values()} == {0, 9}
    assert S.merge_rare({0: 1, 3: 5, 9: 1, 10: 1}) == {0: 3, 3: 3, 9: 9, 10: 9}
    assert S.merge_rare({0: 1, 3: 5, 9: 1, 10: 4}) == {0: 3, 3: 3, 9: 3, 10: 10}


def test_hot_stratum(spark):
    values = [1.0] * 4000 + [float(v) for v in range(100)]
    got = as_dict(S.stratified_split(rows(spark, values), F.col("k")))
    assert sum(1 for s, p in got.values() if p == "test") == 820


def test_equal_row_numbers_are_told_apart_by_key(spark, monkeypatch):
    monkeypatch.setattr(S, "row_hash", lambda key, seed: (F.length(key) * 0).cast("bigint"))
    got = as_dict(S.stratified_split(rows(spark, [1.0, 2.0] * 10), F.col("k")))
    assert sum(1 for _, p in got.values() if p == "test") == 4


def test_null_targets_drop_out(spark):
    df = rows(spark, range(200)).unionByName(spark.createDataFrame([("x", None)], "k string, bail_amount double"))
    assert "x" not in as_dict(S.stratified_split(df, F.col("k")))

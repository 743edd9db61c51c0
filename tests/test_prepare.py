import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gavelstat.operators import prepare as P
from gavelstat.schema import SEVERITY_WEIGHTS


def cohort(spark, n=240):
    rng = np.random.default_rng(5)
    weights = [*SEVERITY_WEIGHTS, "ZZ"]
    rows = [
        (
            f"k{i}",
            None if i % 11 == 0 else ["F", "M"][i % 2],
            None if i % 7 == 0 else int(rng.integers(18, 70)),
            str(rng.integers(0, 30)),
            weights[i % len(weights)],
            "N/A" if i == 3 else f"{rng.gamma(2, 900):.2f}",
            None if i % 5 == 0 else str(rng.integers(0, 12)),
            f"judge {rng.integers(0, 9)}",
            float([50000, 61000, 72500][i % 3]),
            ["a", "b"],
        )
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "k string, gender string, age_at_arrest int, known_days_in_custody string, top_charge_weight_at_arraign string, "
        "first_bail_set_cash string, prior_misd_cnt string, judge_name string, median_household_income double, tags array<string>",
    )


def by_hand(pdf, null_policy="impute", numeric_text=()):
    """The same chain in pandas, one plain step after another."""
    pdf = pdf.copy()
    pdf["bail_amount"] = pd.to_numeric(pdf.pop("first_bail_set_cash"), errors="coerce")
    pdf = pdf[pdf["bail_amount"] <= pdf["bail_amount"].quantile(0.99)].drop(columns=["tags"])
    for c in numeric_text:
        pdf[c] = pd.to_numeric(pdf[c], errors="coerce")
    numeric = ["age_at_arrest", "median_household_income", *numeric_text]
    labels = [c for c in pdf.columns if c not in [*numeric, "k", "bail_amount"]]
    for c in numeric:
        pdf[c] = pdf[c].astype(float).fillna(pdf[c].astype(float).median())
    for c in labels:
        fill = "None" if null_policy == "category" else pdf[c].dropna().mode().sort_values().iloc[0]
        pdf[c] = pdf[c].where(pdf[c].notna(), fill)
    w = "top_charge_weight_at_arraign"
    pdf[w] = pdf[w].map(SEVERITY_WEIGHTS).fillna(0.0)
    for c in labels:
        if c != w:
            order = {v: i for i, v in enumerate(sorted(pdf[c].unique()))}
            pdf[c] = pdf[c].map(order).astype(float)
    for c in ("median_household_income", "known_days_in_custody", "age_at_arrest", "prior_misd_cnt"):
        pdf[c] = (pdf[c] - pdf[c].mean()) / pdf[c].std(ddof=0)
    pdf["bail_amount"] = pdf["bail_amount"] / pdf["bail_amount"].max()
    return pdf.sort_values("k").reset_index(drop=True)


@pytest.mark.parametrize("options", [{}, {"null_policy": "category"}, {"text_numeric": "numeric"}])
def test_chain_against_pandas(spark, options):
    df = cohort(spark)
    got, learned = P.prepare(df, ["k"], **options)
    got = got.toPandas().sort_values("k").reset_index(drop=True)
    text = ["known_days_in_custody", "prior_misd_cnt"] if options.get("text_numeric") else []
    want = by_hand(df.toPandas(), options.get("null_policy", "impute"), text)
    assert len(got) == len(want)
    for c in want.columns.drop("k"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-9, err_msg=c)
    assert learned.features[:2] == ["age_at_arrest", "median_household_income"] or text


def test_scoring_uses_the_fitted_statistics(spark):
    df = cohort(spark)
    whole, learned = P.prepare(df, ["k"])
    one = learned.transform(df.filter("k = 'k20'").drop("first_bail_set_cash"), ["k"]).toPandas()
    same = whole.filter("k = 'k20'").toPandas()
    for c in learned.features:
        assert one[c][0] == pytest.approx(same[c][0])
    assert "bail_amount" not in one


def test_cap_keeps_the_threshold_and_drops_null(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)] + [(None,)], "bail_amount double")
    assert P.quantile_cap(df).count() == 100


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, None), (5.0, 3.0)], "age_at_arrest double, population double")
    got = P.standardize(df).toPandas()
    assert got["age_at_arrest"].tolist() == [0.0, 0.0, 0.0]
    np.testing.assert_allclose(got["population"], [-1.0, np.nan, 1.0])


def test_scale_by_max_equals_deviation_then_max(spark):
    v = np.array([1.0, 4.0, 10.0])
    df = spark.createDataFrame([(float(x),) for x in v], "bail_amount double")
    scaled = v / v.std()
    np.testing.assert_allclose([r[0] for r in P.scale_by_max(df).collect()], scaled / scaled.max())


def test_adaptive_bins_equal_the_loop(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.uniform(0, 10, 40), [25.0, 26.0, 60.0, 61.0]])
    bins = 10
    while (pd.cut(pd.Series(values), bins, labels=False).value_counts() < 2).any():
        bins -= 1
    got = P.adaptive_bin(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").toPandas()
    assert set(got["bins"]) == {bins}
    assert got["bin"].tolist() == pd.cut(pd.Series(values), bins, labels=False).tolist()


def test_adaptive_bins_need_enough_rows(spark):
    with pytest.raises(ValueError, match="more rows"):
        P.adaptive_bin(spark.createDataFrame([(1.0,), (9.0,)], "v double"), "v")


def test_small_steps(spark):
    df = cohort(spark, 30)
    assert "tags" not in P.drop_array_columns(df).columns
    assert P.partition_by_type(df, ["k"]).columns[:3] == ["k", "age_at_arrest", "median_household_income"]
    holes = spark.createDataFrame([(1, None, None), (2, 1, None)], "k int, a int, b int")
    assert [r["k"] for r in P.drop_all_null_rows(holes, ["a", "b"]).collect()] == [2]
    x, y = P.separate(P.coerce_target(df), key=["k"], bins=10)
    assert "bail_amount" not in x.columns and y.columns == ["k", "bail_amount"]
    hot = P.one_hot(spark.createDataFrame([("a",), ("b",), (None,)], "t string"), "t")
    assert [tuple(r) for r in hot.collect()] == [(1, 0), (0, 1), (0, 0)]
    with pytest.raises(ValueError, match="more than 1 labels"):
        P.one_hot(spark.createDataFrame([("a",), ("b",), (None,)], "t string"), "t", max_labels=1)
    sparse = P.one_hot(spark.createDataFrame([("a",), ("b",), (None,)], "t string"), "t", "map")
    assert [r["t_labels"] for r in sparse.collect()] == [{"t_a": 1}, {"t_b": 1}, {}]
    assert P.value_counts(df, "gender").agg(F.sum("n")).first()[0] == 30

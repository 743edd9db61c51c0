import pytest
from pyspark.sql import functions as F

from gavelstat.functions import codes as C
from gavelstat.operators import prepare as P


def frame(spark):
    rows = [("10", "x"), ("2", "y"), ("1", "y"), ("10", "x"), ("2", None), ("", None), (None, None)]
    return spark.createDataFrame(rows, "n string, t string")


def test_string_order(spark):
    coded = P.label_encode(frame(spark).dropna(), ["n"])
    got = {r["n"] for r in coded.collect()}
    assert got == {0.0, 1.0, 2.0}
    table = {r["value"]: r["code"] for r in P.fit_labels(frame(spark), ["n"]).codes.collect()}
    assert table == {"": 0, "1": 1, "10": 2, "2": 3}


def test_mode_takes_smallest_on_ties_and_skips_null(spark):
    top = C.label_summary(C.frequencies(frame(spark), ["n", "t"]))
    assert top == {"n": (4, "10", 4), "t": (2, "x", 2)}
    filled = [r["t"] for r in P.impute_mode(frame(spark), ["t"]).collect()]
    assert filled == ["x", "y", "y", "x", "x", "x", "x"]


def test_all_null_column_has_no_mode(spark):
    df = spark.createDataFrame([(None,), (None,)], "t string")
    assert [r["t"] for r in P.impute_mode(df, ["t"]).collect()] == [None, None]


def test_slices_give_the_same_codes(spark):
    labels = spark.range(5000).select(
        F.lit("k").alias("feature"), F.concat(F.lit("Supplier#"), F.col("id").cast("string")).alias("value")
    )
    labels = labels.unionByName(spark.createDataFrame([("g", "F"), ("g", "M")], "feature string, value string"))
    sizes = {"k": 5000, "g": 2}
    plain = {(r[0], r[1]): r[2] for r in C.rank_codes(labels, sizes).collect()}
    sliced = {(r[0], r[1]): r[2] for r in C.rank_codes(labels, sizes, window_labels=100, slice_labels=300).collect()}
    assert plain == sliced
    want = sorted(f"Supplier#{i}" for i in range(5000))
    assert [plain["k", v] for v in want] == list(range(5000))


def test_unseen_label(spark):
    encoder = P.fit_labels(spark.createDataFrame([("a",), ("b",)], "t string"), ["t"])
    new = spark.createDataFrame([("b",), ("z",)], "t string")
    with pytest.raises(Exception, match="unseen label in t: z"):
        encoder.transform(new).collect()
    assert [r["t"] for r in encoder.transform(new, "keep").collect()] == [1.0, 2.0]


def test_new_rows_get_own_encoder_where_none_was_fitted(spark):
    encoder = P.fit_labels(spark.createDataFrame([("a",), ("b",)], "t string"), ["t"])
    new = spark.createDataFrame([("b", "q", 1.0), ("a", "p", None), ("a", "p", 4.0)], "t string, u string, x double")
    got = P.label_encode_new(new, encoder, ["t", "u"]).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 1.0), (0.0, 0.0, 2.5), (0.0, 0.0, 4.0)]

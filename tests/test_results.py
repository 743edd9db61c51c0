from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gavelstat.functions.columns import to_number
from gavelstat.operators import cohort as K
from gavelstat.operators import quality as Q
from gavelstat.operators import results as S
from gavelstat.operators import rollups as R
from gavelstat.operators import star_load as L
from gavelstat.plans import training as T
from gavelstat.schema import PROFILE_SCHEMA, SCHEMAS
from gavelstat.sources import outputs as O
from gavelstat.sources.star import read_star, write_star
from gavelstat.sources.tpch_star import bind_star
from gavelstat.workspace import materialize, new_path, release

from conftest import SF


def profile(spark, rows):
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def test_wide_rows(spark):
    long = spark.createDataFrame([("r1", "race", 0.25), ("r1", "gender", 0.75)], "run string, Feature string, Importance double")
    row = S.result_rows(long, ["run"]).first()
    assert (row["race_importance"], row["gender_importance"], row["pend_vfo_importance"]) == (0.25, 0.75, None)
    bad = long.withColumn("Feature", F.lit("shoe_size"))
    with pytest.raises(Exception, match="shoe_size"):
        S.result_rows(bad, ["run"]).collect()


def test_profiles_against_a_baseline(spark):
    mine = profile(spark, [("a", 0.7), ("b", 0.3)])
    base = profile(spark, [("a", 0.5), ("c", 0.5)])
    (row,) = S.compare_profile(mine, base).collect()
    assert row["Feature"] == "a" and row["Difference"] == pytest.approx(0.2)


def test_top_features_break_ties_by_name(spark):
    rows = [(f"f{i:02d}", 0.1) for i in range(30)] + [("z", 0.5)]
    got = [r["Feature"] for r in S.top_features(profile(spark, rows)).collect()]
    assert got[:3] == ["z", "f00", "f01"] and len(got) == 20


def test_wording_of_changes(spark):
    runs = spark.createDataFrame(
        [("x", 1, 0.5), ("x", 2, 0.75), ("x", 3, 0.75), ("x", 4, 0.7), ("y", 1, 0.1)], "model_target string, run_id int, average_r2 double"
    ).withColumn("run_ts", F.timestamp_seconds("run_id"))
    got = {(r["model_target"], r["run_id"]): r["r2_comparison"] for r in S.compare_runs(runs).collect()}
    assert got == {
        ("x", 1): "No previous R² value", ("x", 2): "R² increased by 0.2500", ("x", 3): "R² stayed the same",
        ("x", 4): "R² decreased by 0.0500", ("y", 1): "No previous R² value",
    }


def test_target_precedence(spark):
    df = spark.createDataFrame([("j", "c"), ("", "c"), (None, None), ("", "")], "j string, c string")
    got = df.select(S.target_type(F.col("j"), F.col("c")), S.target_name(F.col("j"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [
        ("judge_name", "j"), ("county_name", "c"), ("baseline", "baseline"), ("baseline", "baseline"),
    ]


def test_profile_csv(spark):
    path = new_path(spark, "profile")
    O.write_profile_csv(profile(spark, [("b", 0.25), ("a", 0.75)]), path)
    assert [tuple(r) for r in O.read_profile_csv(spark, path).collect()] == [("a", 0.75), ("b", 0.25)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        O.read_profile_csv(spark, path + "-missing")


def test_feature_store_and_profiles(spark):
    rows = spark.createDataFrame([("k1", 1.0, "train"), ("k2", 2.0, "test")], "k string, x double, split string")
    path = O.write_features(rows, new_path(spark, "features"))
    assert O.read_features(spark, path, "test").select("k").first()[0] == "k2"
    assert O.read_features(spark, path).count() == 2
    stored = new_path(spark, "profiles")
    both = spark.createDataFrame([("p", "a", 1.0), ("q", "a", 0.5)], "profile string, Feature string, Importance double")
    O.write_profiles(both, stored)
    O.write_profiles(both.filter("profile = 'p'").withColumn("Importance", F.lit(0.9)), stored)
    got = {r["profile"]: r["Importance"] for r in spark.read.parquet(stored).collect()}
    assert got == {"p": 0.9, "q": 0.5}


def test_quality_checks(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, None)], "fk int, v string")
    parent = spark.createDataFrame([(1,)], "id int")
    assert [r["v"] for r in Q.orphans(child, "fk", parent, "id").collect()] == ["b"]
    assert [tuple(r) for r in Q.duplicate_keys(child, ["fk"]).collect()] == [(1, 2)]
    assert {tuple(r) for r in Q.null_counts(child, ["fk", "v"]).collect()} == {("fk", 1), ("v", 1)}
    kinds = spark.createDataFrame([("baseline",), ("court",), (None,)], "t string")
    assert [tuple(r) for r in Q.out_of_domain(kinds, "t").collect()] == [("court", 1)]
    numbers = spark.createDataFrame([("1", None), ("x", None)], "a string, b string")
    got = {r["column_name"]: tuple(r)[1:] for r in Q.unparsable_numbers(numbers, ["a", "b"]).collect()}
    assert got == {"a": (2, 1, 0.5), "b": (0, 0, None)}


def test_star_round_trip(spark):
    """A star written and read with the declared schemas."""
    star = bind_star(spark, SF)
    folder = new_path(spark, "star")
    full = {}
    for name, table in star.tables().items():
        columns = [
            (F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields
        ]
        full[name] = table.select(*columns)
    full["cases"] = full["cases"].withColumn("arrest_year", F.lit("2020"))
    write_star(type(star)(**full), folder)
    again = read_star(spark, folder)
    assert K.base_cohort(again).count() == K.base_cohort(star).count() > 0
    assert len(again.cases.columns) == 110
    assert R.rollup_judge(again).count() == 10


def test_flat_records_to_star(spark):
    flat = spark.createDataFrame(
        [("1", "white", "Kings", "10.5"), ("2", "white", "Queens", "x"), ("3", None, "Kings", None)],
        "id string, race string, county string, first_bail_set_cash string",
    )
    specs = [L.DimensionSpec("races", "race_id", ["race"]), L.DimensionSpec("counties", "county_id", ["county"])]
    fact, dims = L.normalize_flat(flat, specs)
    assert (dims["races"].count(), dims["counties"].count()) == (1, 2)
    rows = {r["id"]: r for r in fact.collect()}
    assert rows["3"]["race_id"] is None and rows["1"]["county_id"] == rows["3"]["county_id"]
    assert [rows[i]["bail_amount"] for i in "123"] == [10.5, None, None]


def test_stored_amounts_reach_the_scan(spark):
    star = bind_star(spark, SF)
    path = new_path(spark, "cases")
    star.cases.withColumn("bail_amount", to_number(F.col("first_bail_set_cash"))).write.parquet(path)
    typed = star.with_cases(spark.read.parquet(path))
    scan = K.amount_in_range(typed.cases).select("race_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(bail_amount,1.0)" in scan and "LessThan(bail_amount,39000.0)" in scan
    assert K.base_cohort(typed).count() == K.base_cohort(star).count()


def test_stored_star_is_read_with_its_typed_amounts(spark):
    star = bind_star(spark, SF)
    typed = star.with_cases(star.cases.withColumn("bail_amount", to_number(F.col("first_bail_set_cash"))))
    folder = new_path(spark, "star")
    write_star(typed, folder)
    scan = K.amount_in_range(read_star(spark, folder).cases).select("race_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(bail_amount,1.0)" in scan
    write_star(star, folder + "-plain")
    assert "bail_amount" not in read_star(spark, folder + "-plain").cases.columns
    assert K.base_cohort(read_star(spark, folder)).count() == K.base_cohort(star).count()


def test_cases_are_not_shuffled_by_a_hot_key(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4096")
    try:
        plan = K.base_cohort(bind_star(spark, SF))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffles = [line for line in plan.split("\n") if "hashpartitioning(" in line]
    assert shuffles and not any(f"hashpartitioning({k}#" in s for s in shuffles for k in ("race_id", "court_id", "county_name", "county_id"))


def test_released_tables_are_gone(spark):
    stored = materialize(spark.range(3), "some")
    folder = Path(stored.stored_at.removeprefix("file:").replace("//", "/"))
    assert folder.exists() and stored.count() == 3
    release(stored)
    assert not folder.exists()


def test_cohort_guards(spark):
    star = bind_star(spark, SF)
    cohort = K.base_cohort(star)
    with pytest.raises(ValueError, match="required column"):
        K.require_columns(cohort.drop("first_bail_set_cash"))
    with pytest.raises(KeyError, match="shoe"):
        K.unique_values(cohort, "shoe")
    assert len(cohort.columns) == 16
    assert len(K.base_cohort(star, judge="Supplier#1").columns) == 15
    assert len(K.base_cohort(star, county="NATION_1").columns) == 14
    assert K.base_cohort(star, judge="", county="").columns == cohort.columns
    assert K.restrict(K.base_cohort(star, keep=["internal_case_id"]), limit=25).count() == 25


def test_training_and_grading_runs(spark):
    star = bind_star(spark, SF)
    small = {"gradient_boosting": {"n_estimators": 3}}
    run = T.run_training(star, types=["gradient_boosting", "ridge"], params=small)
    summary = {r["model_type"]: r for r in run.summary.collect()}
    assert set(summary) == {"gradient_boosting", "ridge"}
    assert {r["num_features"] for r in summary.values()} == {15} and {r["model_target"] for r in summary.values()} == {"baseline"}
    assert summary["ridge"]["total_cases"] == K.base_cohort(star).count()
    assert run.train_rows.count() + run.test_rows.count() == run.rows.count()
    wide = S.result_rows(run.profiles, ["run_id", "model_type"])
    assert wide.count() == 2  # ridge has no importances of its own, its features are permuted
    graded = T.run_grading(star, run.models[0], run.preparation)
    assert graded.count() == 10 and "judge_name" in graded.columns
    assert T.run_grading(star, run.models[1], run.preparation, by="county_name", limit=3).count() == 3


def test_preparation_learned_on_the_training_part(spark):
    star = bind_star(spark, SF)
    _, rows, learned = T.prepared_split(star, "internal_case_id", fit_on="train")
    parts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    _, rows_all, _ = T.prepared_split(star, "internal_case_id")
    assert parts == {r["split"]: r["count"] for r in rows_all.groupBy("split").count().collect()}
    means = rows.filter("split = 'train'").agg(F.avg("age_at_arrest")).first()[0]
    assert abs(means) < 1e-9


def test_a_run_is_stored_compared_and_replaced(spark, tmp_path):
    star = bind_star(spark, SF)
    small = {"random_forest": {"n_estimators": 2, "max_depth": 2}}
    run = T.run_training(star, types=["random_forest", "ridge"], params=small)
    folder = f"file://{tmp_path}"
    baseline = profile(spark, [("race", 0.5), ("gender", 0.5)])
    stored = T.persist_run(run, folder, baseline)
    T.persist_run(run, folder, baseline)  # a retry
    rows = O.read_runs(spark, stored.results).collect()
    assert sorted(r.model_type for r in rows) == ["random_forest", "ridge"]
    assert {r.r2_comparison for r in rows} == {"No previous R² value"}
    assert all(r.race_importance is not None and r.time_elapsed > 0 for r in rows)
    assert spark.read.parquet(stored.comparison).count() == 4
    phi = spark.read.parquet(f"{stored.attributions}/{rows[0].run_id}/random_forest")
    assert phi.count() == run.test_rows.count() * 15
    again = T.run_training(star, types=["ridge"])
    T.persist_run(again, folder)
    (row,) = O.read_runs(spark, stored.results).filter(F.col("run_id") == again.summary.first().run_id).collect()
    assert row.r2_comparison.startswith("R²") and row.model_params == '{"alpha": 0.1}'
    graded = T.grade_stored(stored, run, "ridge", star)
    whole = run.test_rows.count()
    assert 0 < graded.agg(F.sum("n")).first()[0] <= whole

"""A case star bound onto TPC-H-like tables.

Line items stand in for cases, suppliers for judges, nations for counties, regions
for districts, brands for courts, market segments for races, part types for charges
and the customer's nation for the representation.  The amount is text with planted
bad values and NULLs, as in real case records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelstat.schema import Star
from gavelstat.workspace import spread


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; its footer is read for the schema once per process, not once per use."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _text(value):
    return value.cast("int").cast("string")


def _yes(condition):
    return F.when(condition, F.lit("Y")).otherwise(F.lit("N"))


def bind_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table with text-typed numbers and opaque foreign keys.

    No join is hinted: dimension sizes grow with the data, so the planner decides by
    their statistics and adaptive execution corrects it.
    """
    lines, orders = spread(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "orders")
    customers, parts = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    line, flag, priority = F.col("l_linenumber"), F.col("l_returnflag"), F.col("o_orderpriority")
    weight = (
        F.when(priority == "1-URGENT", "AF").when(priority == "2-HIGH", "CF").when(priority == "3-MEDIUM", "EF")
        .when(priority == "5-LOW", "UM")
    )
    amount = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return joined.select(
        key.alias("internal_case_id"),
        F.col("l_linestatus").alias("gender"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("ethnicity"),
        F.when(F.col("p_size") != 50, F.col("p_size")).alias("age_at_arrest"),
        F.datediff("l_shipdate", "o_orderdate").cast("string").alias("known_days_in_custody"),
        weight.alias("top_charge_weight_at_arraign"),
        F.when(line == 7, F.lit("N/A")).when((line == 6) & (flag == "N"), F.lit(None)).otherwise(amount)
        .alias("first_bail_set_cash"),
        _text(line).alias("prior_vfo_cnt"),
        _text(F.round(F.col("l_discount") * 100)).alias("prior_nonvfo_cnt"),
        F.when(F.col("l_quantity") != 13, _text(F.col("l_quantity"))).alias("prior_misd_cnt"),
        _text(F.round(F.col("l_tax") * 100)).alias("pend_nonvfo"),
        _text(F.col("p_size") % 10).alias("pend_misd"),
        F.month("o_orderdate").cast("string").alias("pend_vfo"),
        _yes(line == 1).alias("remanded_to_jail_at_arraign"),
        _yes(line == 2).alias("ror_at_arraign"),
        _yes(line == 3).alias("nmr_at_arraign"),
        _yes(line.isin(4, 5)).alias("bail_set_and_posted_at_arraign"),
        _yes(line.isin(6, 7)).alias("bail_set_and_not_posted_at_arraign"),
        F.when(flag == "A", "Dismissed").when(flag == "R", "Convicted").alias("disposition_type"),
        _yes(F.col("l_tax") > 0.055).alias("rearrest"),
        F.when(flag == "R", weight).alias("top_charge_weight_at_conviction"),
        F.concat_ws(" ", flag, "l_linestatus").alias("pretrial_supervision_at_arraign"),
        F.col("c_mktsegment").alias("arraign_charge_category"),
        F.col("p_type").alias("top_charge_at_arraign"),
        F.col("c_mktsegment").alias("race_id"),
        F.col("s_nationkey").alias("county_id"),
        F.col("l_suppkey").alias("judge_id"),
        F.col("n_regionkey").alias("district_id"),
        F.col("p_brand").alias("court_id"),
        F.col("c_nationkey").alias("representation_id"),
        F.col("p_type").alias("top_charge_id"),
        F.col("p_type").alias("crime_id"),
    )


def bind_star(spark: SparkSession, sf_dir: str) -> Star:
    """Fact table and dimensions; the keys are the source tables' own."""
    customers, parts = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    suppliers = table(spark, sf_dir, "supplier")
    cents = F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint"))
    income = customers.groupBy("c_nationkey").agg((cents / F.count("*") / 100).alias("median_household_income"))
    income = income.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_nationkey").alias("income_uuid"), F.col("n_name").alias("county"), "median_household_income"
    )
    segments = customers.select("c_mktsegment").distinct()
    types = parts.select("p_type").distinct()
    brands = parts.select("p_brand").distinct()
    return Star(
        cases=bind_cases(spark, sf_dir),
        races=segments.select(F.col("c_mktsegment").alias("race_uuid"), F.col("c_mktsegment").alias("race")),
        counties=nations.select(F.col("n_nationkey").alias("county_uuid"), F.col("n_name").alias("county_name")),
        ny_income=income,
        judges=suppliers.select(F.col("s_suppkey").alias("judge_uuid"), F.col("s_name").alias("judge_name")),
        districts=regions.select(F.col("r_regionkey").alias("district_uuid"), F.col("r_name").alias("district_name")),
        courts=brands.select(F.col("p_brand").alias("court_uuid"), F.col("p_brand").alias("court_name")),
        representation=nations.select(
            F.col("n_nationkey").alias("representation_uuid"), F.col("n_name").alias("representation_type")
        ),
        crimes=types.select(F.col("p_type").alias("crime_uuid"), F.col("p_type").alias("top_charge_at_arrest")),
    )

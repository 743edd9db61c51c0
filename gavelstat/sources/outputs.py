"""Sinks and the readers of what they wrote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstat.schema import PROFILE_SCHEMA


def read_profile_csv(spark: SparkSession, path: str) -> DataFrame:
    """A stored importance profile; a missing path raises, as does a malformed line."""
    return spark.read.csv(path, schema=PROFILE_SCHEMA, header=True, mode="FAILFAST")


def write_profile_csv(profile: DataFrame, path: str) -> str:
    """One profile as CSV, most important feature first (a profile has one row per feature)."""
    ordered = profile.select("Feature", "Importance").orderBy(F.desc("Importance"), "Feature")
    ordered.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def write_profiles(profiles: DataFrame, path: str, by: Sequence[str] = ("profile",)) -> str:
    """Many named profiles in one table, one partition per profile; a rewrite replaces only its own."""
    writer = profiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(path)
    return path


def write_features(split: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Prepared rows with key, features and target, one partition per part of the split."""
    split.write.mode("overwrite").partitionBy("split").format(fmt).save(path)
    return path


def read_features(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    """Stored features, all or one part; only that part's files are read."""
    stored = spark.read.parquet(path)
    return stored.filter(F.col("split") == part) if part else stored


def write_runs(rows: DataFrame, path: str) -> str:
    """Add the rows of runs, one partition per run_id; writing a run again replaces it."""
    writer = rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)
    return path


def read_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """What ``write_runs`` has stored; None before the first run."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))


def append_rows(rows: DataFrame, path: str) -> str:
    """Append rows; a retry after a lost commit repeats them, ``write_runs`` is safe from that."""
    rows.write.mode("append").parquet(path)
    return path


def write_attributions(attributions: DataFrame, path: str) -> str:
    """Per-row attributions in long form (row, feature, value)."""
    attributions.write.mode("overwrite").parquet(path)
    return path

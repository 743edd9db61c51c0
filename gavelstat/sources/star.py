"""Reading the star from parquet or from a relational database."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelstat.schema import SCHEMAS, TARGET, Star

CASE_KEY = "internal_case_id"
#: Keys looked at for each slice of a table that is read over JDBC.
SLICE_SAMPLE = 1000


def read_star(spark: SparkSession, folder: str) -> Star:
    """Star stored as one parquet table per entity; schemas are declared, not inferred.

    A fact table partitioned by ``arrest_year`` is pruned by filters on it.  Where amounts are also stored as
    numbers, as ``normalize_flat`` does, that column is read too, and predicates on it reach the scan.
    """
    schemas = dict(SCHEMAS)
    if TARGET in spark.read.parquet(f"{folder}/cases").columns:
        schemas["cases"] = T.StructType([*schemas["cases"].fields, T.StructField(TARGET, T.DoubleType())])
    return Star(**{n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in schemas.items()})


def read_star_jdbc(
    spark: SparkSession, schema: str = "pretrial", partitions: int = 64, url: str | None = None, **options: str
) -> Star:
    """Star stored in a database; address and credentials come from DB_* variables.

    The fact table is read in up to ``partitions`` parallel slices, ranges of its key that hold about as many rows each
    and that an index on the key answers.
    """
    env = os.environ
    url = url or f"jdbc:postgresql://{env['DB_HOST']}:{env['DB_PORT']}/{env['DB_NAME']}"
    common = {"url": url, "user": env.get("DB_USER", ""), "password": env.get("DB_PASSWORD", ""), **options}
    tables = {}
    for name, struct in SCHEMAS.items():
        reader = spark.read.format("jdbc").options(**common).option("dbtable", f"{schema}.{name}")
        if name == "cases":
            predicates = _case_slices(spark, common, f"{schema}.{name}", partitions)
            properties = {k: v for k, v in common.items() if k != "url"}
            table = spark.read.jdbc(url, f"{schema}.{name}", predicates=predicates, properties=properties)
        else:
            table = reader.load()
        tables[name] = table.select(*[F.col(f.name).cast(f.dataType) for f in struct.fields])
    return Star(**tables)


def bounds_sql(table: str, key: str, slices: int, sample: str = "") -> str:
    """SQL for the lower bounds of slices with about as many rows each: at most ``slices`` values, in the database's order.

    ``sample`` is the database's clause for a sample of ``table``; the order, and so the collation of the key, is
    that of the database, which will compare keys with the bounds too.
    """
    return (
        f"SELECT min({key}) AS low FROM (SELECT {key}, ntile({slices}) OVER (ORDER BY {key}) AS slice "
        f"FROM {table} {sample} WHERE {key} IS NOT NULL) ranked GROUP BY slice ORDER BY slice"
    )


def range_predicates(key: str, bounds: Sequence[str]) -> list[str]:
    """Predicates of which every row, also one without a key, meets exactly one.

    ``bounds`` are in the database's order; the first slice also has all keys below the first bound.
    """
    cuts = ["'" + b.replace("'", "''") + "'" for b in list(dict.fromkeys(bounds))[1:]]
    if not cuts:
        return ["1 = 1"]
    first, last = f"({key} < {cuts[0]} OR {key} IS NULL)", f"{key} >= {cuts[-1]}"
    return [first, *[f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:])], last]


def _case_slices(spark: SparkSession, options: dict[str, str], table: str, slices: int) -> list[str]:
    """Ranges of the key from a sample of the fact table's pages; the database works out the bounds."""
    def ask(sql: str) -> list:
        return [row[0] for row in spark.read.format("jdbc").options(**options).option("query", sql).load().collect()]

    (rows,) = ask(f"SELECT reltuples::float8 FROM pg_class WHERE oid = '{table}'::regclass")
    share = min(100.0, 100.0 * slices * SLICE_SAMPLE / max(rows, 1.0))
    sample = f"TABLESAMPLE SYSTEM ({share:.9f}) REPEATABLE (1)"
    return range_predicates(CASE_KEY, ask(bounds_sql(table, CASE_KEY, slices, sample)))


def write_star(star: Star, folder: str) -> None:
    """Store the star as parquet in the declared types, the fact table partitioned by year where it has one."""
    for name, table in star.tables().items():
        declared = {f.name: f.dataType for f in SCHEMAS[name].fields}
        typed = table.select(*[F.col(c).cast(declared.get(c, table.schema[c].dataType)) for c in table.columns])
        writer = typed.write.mode("overwrite")
        if name == "cases" and "arrest_year" in table.columns:
            writer = writer.partitionBy("arrest_year")
        writer.parquet(f"{folder}/{name}")


def table_sizes(star: Star) -> DataFrame:
    """Rows per table."""
    counts = [
        t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        for n, t in star.tables().items()
    ]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result

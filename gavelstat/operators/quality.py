"""Checks for the constraints the star declares, which Spark does not enforce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstat.functions.columns import to_number
from gavelstat.schema import FOREIGN_KEYS, TARGET_TYPES, TEXT_NUMBERS, UNIQUE_KEYS, Star


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row.  As in SQL, a key with a NULL never clashes."""
    return df.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def duplicate_key_counts(star: Star) -> DataFrame:
    """Number of violated keys per table, for the keys that are present."""
    parts = []
    for name, key in UNIQUE_KEYS.items():
        table = getattr(star, name)
        if set(key) <= set(table.columns):
            counted = duplicate_keys(table, key).agg(F.count("*").alias("violations"))
            parts.append(counted.select(F.lit(name).alias("table_name"), "violations"))
    return _union(parts)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    return child.filter(F.col(key).isNotNull()).join(
        parent.select(F.col(parent_key).alias("__parent")), F.col(key) == F.col("__parent"), "left_anti"
    )


def orphan_counts(star: Star) -> DataFrame:
    """Orphans per foreign key of the fact table.

    References are counted per key value first, so the anti joins see distinct keys only.
    """
    parts = []
    for key, (name, uid) in FOREIGN_KEYS.items():
        used = star.cases.groupBy(key).agg(F.count("*").alias("n"))
        lost = orphans(used, key, getattr(star, name), uid)
        parts.append(lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
                     .select(F.lit(key).alias("foreign_key"), "violations"))
    return _union(parts)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column, in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _unpivot(counted, columns, "violations")


def out_of_domain(df: DataFrame, column: str, domain: Sequence[str] = TARGET_TYPES) -> DataFrame:
    """Values outside an enumeration, with their frequency."""
    bad = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(domain)))
    return bad.groupBy(column).agg(F.count("*").alias("n"))


def unparsable_numbers(df: DataFrame, columns: Sequence[str] = (*TEXT_NUMBERS, "first_bail_set_cash")) -> DataFrame:
    """Per text-number column: rows, values and values that do not parse, in one pass."""
    aggs = []
    for c in columns:
        value = F.col(c)
        aggs += [F.count(value).alias(f"{c}|n"),
                 F.count_if(value.isNotNull() & to_number(value).isNull()).alias(f"{c}|bad")]
    row = df.agg(*aggs)
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}|n`").alias("n_values"), F.col(f"`{c}|bad`").alias("n_bad"))
        for c in columns
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select(
        "e.*", F.try_divide(F.col("e.n_bad"), F.col("e.n_values")).alias("bad_share")
    )


def _unpivot(row: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    return row.unpivot([], list(columns), "column_name", value)


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result

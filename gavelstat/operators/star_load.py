"""Flat case records to a star with derived keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstat.functions.columns import surrogate_key, to_number
from gavelstat.schema import RAW_TARGET


@dataclass(frozen=True)
class DimensionSpec:
    """A dimension held inside flat records: its name, key column and natural key."""

    name: str
    foreign_key: str
    natural_key: Sequence[str]
    attributes: Sequence[str] = ()


def add_surrogate_key(df: DataFrame, natural_key: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, surrogate_key(*[F.col(c).cast("string") for c in natural_key]))


def dimension(flat: DataFrame, spec: DimensionSpec) -> DataFrame:
    """Distinct natural keys with an id; attributes are those of the smallest combination."""
    keys, extra = list(spec.natural_key), list(spec.attributes)
    rows = flat.select(*keys, *extra).dropna(subset=keys)
    if extra:
        first = F.min(F.struct(*extra)).alias("a")
        rows = rows.groupBy(*keys).agg(first).select(*keys, *[F.col(f"a.{c}").alias(c) for c in extra])
    else:
        rows = rows.distinct()
    return add_surrogate_key(rows, keys, f"{spec.name}_uuid")


def normalize_flat(flat: DataFrame, specs: Sequence[DimensionSpec]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Fact table with foreign keys, and the dimensions.

    An id is a function of the natural key, so the fact needs no join back to get it.
    The amount is also stored as a number, which lets range predicates reach the scan.
    """
    dimensions = {s.name: dimension(flat, s) for s in specs}
    ids = {}
    for s in specs:
        known = F.lit(True)
        for c in s.natural_key:
            known = known & F.col(c).isNotNull()
        ids[s.foreign_key] = F.when(known, surrogate_key(*[F.col(c).cast("string") for c in s.natural_key]))
    moved = [c for s in specs for c in [*s.natural_key, *s.attributes]]
    fact = flat.withColumns(ids)
    if RAW_TARGET in flat.columns:
        fact = fact.withColumn("bail_amount", to_number(F.col(RAW_TARGET)))
    return fact.drop(*moved), dimensions

"""Ranks within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelstat.workspace import materialize

WINDOW_ROWS = 1_000_000
SLICES = 200


def descending_rank(
    df: DataFrame, by: Sequence[str], value: Column, name: str = "rank", window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """``rank()`` by falling ``value`` within each ``by`` group, missing values last.

    Up to ``window_rows`` rows a plain window does.  Beyond, values are counted first, so ties
    weigh nothing, and each group's distinct values are cut at approximate quantiles: a rank
    is one plus the rows with higher values in the same slice and in higher slices.
    """
    by = list(by)
    rows = materialize(df.withColumn("__value", value), "ranked")
    if rows.count() <= window_rows:
        order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("__value"))
        return rows.withColumn(name, F.rank().over(order)).drop("__value")
    ranks = _value_ranks(rows, by).select(
        *[F.col(b).alias(f"__{b}") for b in by], F.col("__value").alias("__v"),
        F.col("__rank").cast("int").alias(name),
    )
    same = F.col("__value").eqNullSafe(F.col("__v"))
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    return rows.join(ranks, same).select(*[c for c in rows.columns if c != "__value"], name)


def _value_ranks(rows: DataFrame, by: list[str]) -> DataFrame:
    values = materialize(rows.groupBy(*by, "__value").agg(F.count("*").alias("__n")), "values")
    steps = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    cuts = values.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(
        F.percentile_approx("__value", steps, F.lit(2000)).alias("__cuts")
    )
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    above = F.array_size(F.filter("__cuts", lambda c: c > F.col("__value")))
    number = F.when(F.col("__value").isNull(), F.lit(SLICES)).otherwise(above)
    sliced = values.join(cuts, same).select(*values.columns, number.alias("__slice"))
    before = lambda *keys: Window.partitionBy(*by, *keys).rowsBetween(Window.unboundedPreceding, -1)
    higher = F.sum("__n").over(before("__slice").orderBy(F.desc_nulls_last("__value")))
    inside = sliced.withColumn("__inside", F.coalesce(higher, F.lit(0)))
    sizes = sliced.groupBy(*by, "__slice").agg(F.sum("__n").alias("__m"))
    offset = F.coalesce(F.sum("__m").over(before().orderBy("__slice")), F.lit(0))
    offsets = sizes.select(
        *[F.col(b).alias(f"__{b}") for b in by], F.col("__slice").alias("__s"), offset.alias("__offset")
    )
    joined = inside.join(offsets, same & (F.col("__slice") == F.col("__s")))
    return joined.select(*by, "__value", (F.col("__inside") + F.col("__offset") + 1).alias("__rank"))

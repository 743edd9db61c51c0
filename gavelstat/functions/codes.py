"""Rank codes of text labels: sorted distinct values numbered from 0.

Labels come from one frequency table over all categorical columns, which also gives
the modes.  A column with few labels is ranked by a window over its labels; one with
very many (every judge of a country, say) is first cut into ranges of sorted labels,
so no task sees more than a slice of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_LABELS = 100_000
SLICE_LABELS = 50_000
MAX_SLICES = 512
BROADCAST_LABELS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, value, n)`` for all ``columns`` in one pass; NULL is counted too."""
    entries = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns
    ]
    return (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.feature", "e.value")
        .agg(F.count("*").alias("n"))
    )


class LabelInfo(NamedTuple):
    """Number of labels of a feature, the most frequent one, and their total length in bytes."""

    labels: int
    mode: str
    size: int

    @property
    def fits_broadcast(self) -> bool:
        return self.labels <= BROADCAST_LABELS and self.size <= BROADCAST_BYTES


def label_summary(freq: DataFrame) -> dict[str, LabelInfo]:
    """Facts per feature; of equally frequent labels the smallest is the mode."""
    rows = (
        freq.filter(F.col("value").isNotNull())
        .groupBy("feature")
        .agg(
            F.count("*").alias("labels"),
            F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("top"),
            F.sum(F.octet_length("value").cast("bigint")).alias("size"),
        )
        .collect()
    )
    return {r["feature"]: LabelInfo(r["labels"], r["top"]["value"], r["size"]) for r in rows}


def rank_codes(
    labels: DataFrame, sizes: dict[str, int], window_labels: int = WINDOW_LABELS,
    slice_labels: int = SLICE_LABELS,
) -> DataFrame:
    """``(feature, value, code)`` for distinct ``labels(feature, value)``."""
    big = [f for f, n in sizes.items() if n > window_labels]
    in_feature = Window.partitionBy("feature").orderBy("value")
    small = labels.filter(~F.col("feature").isin(big)) if big else labels
    coded = small.select("feature", "value", (F.row_number().over(in_feature) - 1).cast("bigint").alias("code"))
    for feature in big:
        coded = coded.unionByName(_sliced_codes(labels, feature, sizes[feature], slice_labels))
    return coded


def _sliced_codes(labels: DataFrame, feature: str, size: int, slice_labels: int) -> DataFrame:
    """Rank the labels of one large feature slice by slice.

    The cuts are a pseudo-random sample of the labels (those with the smallest hashes),
    so slices come out even; any cuts give the same ranks.
    """
    spark = labels.sparkSession
    mine = labels.filter(F.col("feature") == feature).select("feature", "value")
    cuts = min(MAX_SLICES, max(1, size // slice_labels))
    sample = mine.orderBy(F.xxhash64("value"), "value").limit(cuts).select(F.sort_array(F.collect_list("value")))
    edges = F.lit(sample.first()[0])
    sliced = mine.withColumn("slice", F.array_size(F.filter(edges, lambda e: e <= F.col("value"))))
    counts = sorted((r["slice"], r["count"]) for r in sliced.groupBy("slice").count().collect())
    offsets, start = [], 0
    for number, count in counts:
        offsets.append((number, start))
        start += count
    shift = spark.createDataFrame(offsets, "slice int, shift bigint")
    rank = F.row_number().over(Window.partitionBy("slice").orderBy("value"))
    return (
        sliced.withColumn("rank", rank)
        .join(F.broadcast(shift), "slice")
        .select("feature", "value", (F.col("rank") - 1 + F.col("shift")).cast("bigint").alias("code"))
    )


def apply_codes(df: DataFrame, codes: DataFrame, facts: dict[str, LabelInfo], unseen: str = "error") -> DataFrame:
    """Replace each coded column by its code.

    ``unseen='error'`` raises on a label without a code, ``'keep'`` gives the next free
    code.  A code table is broadcast if its counted size allows it; a larger one is joined on the
    label, where adaptive execution splits a dominant one.
    """
    order = df.columns
    for feature, info in facts.items():
        table = codes.filter(F.col("feature") == feature).select(
            F.col("value").alias(feature), F.col("code").alias("__code")
        )
        table = F.broadcast(table) if info.fits_broadcast else table
        label, known = F.col(feature), F.col("__code")
        if unseen == "error":
            message = F.concat(F.lit(f"unseen label in {feature}: "), label)
            missing = known.isNull() & label.isNotNull()
            code = F.when(missing, F.raise_error(message).cast("bigint")).otherwise(known)
        else:
            code = F.when(label.isNotNull(), F.coalesce(known, F.lit(info.labels)))
        df = df.join(table, feature, "left").withColumn(feature, code.cast("double")).drop("__code")
    return df.select(order)

"""Exact stratified train/test split without sorting rows.

Every row has a pseudo-random number from its key.  The test rows of a stratum are
those with the smallest numbers, so all the split needs is one cutoff per stratum,
found by exact selection.  A stratum holding most of the data costs nothing extra.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelstat.functions.columns import row_hash
from gavelstat.functions.order_stats import select_ranks
from gavelstat.operators.prepare import bin_column
from gavelstat.schema import TARGET

BINS = 20
TEST_SHARE = 0.2
TIE_LIMIT = 1_000
HASH_TOP = 2**60 - 1


def allot(counts: dict[int, int], test_total: int) -> dict[int, int]:
    """Test rows per stratum: proportional, largest remainders first, lower stratum on ties."""
    n = sum(counts.values())
    share = {s: c * test_total // n for s, c in counts.items()}
    spare = test_total - sum(share.values())
    by_remainder = sorted(counts, key=lambda s: (-(counts[s] * test_total % n), s))
    for s in by_remainder[:spare]:
        share[s] += 1
    return share


def merge_rare(counts: dict[int, int], least: int = 2) -> dict[int, int]:
    """Map each stratum to the one it joins; rare ones fold into the next lower one."""
    target = {s: s for s in counts}
    total = dict(counts)
    order = sorted(counts)
    for i in range(len(order) - 1, 0, -1):
        s, lower = order[i], order[i - 1]
        if total[s] < least:
            target[s] = lower
            total[lower] += total[s]
    if len(order) > 1 and total[order[0]] < least:
        target[order[0]] = next(s for s in order[1:] if target[s] == s)

    def root(s: int) -> int:
        while target[s] != s:
            s = target[s]
        return s

    return {s: root(s) for s in counts}


def stratified_split(
    df: DataFrame,
    key: Column,
    target: str = TARGET,
    bins: int = BINS,
    test_size: float = TEST_SHARE,
    seed: int = 42,
    rare: str = "merge",
) -> DataFrame:
    """Adds ``stratum`` and ``split`` ('train' or 'test').

    ``key`` must be unique text per row.  ``rare='error'`` refuses strata with a single row,
    ``'merge'`` folds them into their neighbour.  Rows without a target drop out.
    """
    binned = bin_column(df.filter(F.col(target).isNotNull()), target, bins, "stratum")
    counts = {r["stratum"]: r["count"] for r in binned.groupBy("stratum").count().collect()}
    n = sum(counts.values())
    if rare == "error" and min(counts.values(), default=2) < 2:
        raise ValueError("a stratum has a single row; it cannot be in both parts")
    merged = merge_rare(counts)
    moved = {s: t for s, t in merged.items() if s != t}
    stratum = F.col("stratum")
    for s, t in moved.items():
        stratum = F.when(F.col("stratum") == s, F.lit(t)).otherwise(stratum)
        counts[t] += counts.pop(s)
    binned = binned.withColumn("stratum", stratum)
    test_total = math.ceil(n * test_size)
    if n and (test_total < len(counts) or n - test_total < len(counts)):
        raise ValueError("fewer test or train rows than strata")
    share = allot(counts, test_total)
    hashed = binned.withColumn("__h", row_hash(key, seed)).withColumn("__key", key)
    long = hashed.select(F.col("stratum").alias("series"), F.col("__h").alias("x"))
    known = {s: (c, 0, HASH_TOP) for s, c in counts.items()}
    _, found = select_ranks(long, lambda s, _: [share[s] - 1] if share[s] else [], known)
    is_test = F.lit(False)
    for s, ranks in sorted(found.items()):
        if not share[s]:
            continue
        cutoff, below, equal = ranks[share[s] - 1]
        chosen = F.col("__h") <= F.lit(cutoff)
        if below + equal > share[s]:
            chosen = _break_tie(hashed, s, cutoff, share[s] - below, equal)
        is_test = F.when(F.col("stratum") == s, chosen).otherwise(is_test)
    split = F.when(is_test, F.lit("test")).otherwise(F.lit("train"))
    return hashed.withColumn("split", split).drop("__h", "__key")


def _break_tie(hashed: DataFrame, stratum: int, cutoff: int, take: int, equal: int) -> Column:
    """Among the few rows whose numbers equal the cutoff, the smallest keys go to the test part."""
    if equal > TIE_LIMIT:
        raise ValueError(f"{equal} rows share one row number; the key is not unique")
    tied = hashed.filter((F.col("stratum") == stratum) & (F.col("__h") == cutoff))
    keys = sorted(r["__key"] for r in tied.select("__key").collect())[:take]
    return (F.col("__h") < F.lit(cutoff)) | ((F.col("__h") == F.lit(cutoff)) & F.col("__key").isin(keys))

"""Exact order statistics without sorting and without a per-value hash map.

A built-in exact percentile keeps every distinct value of a column in the memory of
one task.  Selection by histogram refinement keeps 1024 cells instead: each pass
counts rows per cell, the cell that holds the wanted rank becomes the next range,
and after a few passes it holds one value.  All columns share each pass, counting is
combined before the shuffle, so neither size nor skew of the data matters.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1024
FETCH_ROWS = 20_000
MAX_SERIES = 10_000


def melt_numbers(df: DataFrame, columns: Sequence[str], dtype: str = "double") -> DataFrame:
    """Long form ``(series, x)`` of numeric columns, without missing values."""
    entries = [F.struct(F.lit(c).alias("series"), F.col(c).cast(dtype).alias("x")) for c in columns]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.series", "e.x")
    return long.filter(_present("x", dtype))


def _present(name: str, dtype: str) -> Column:
    keep = F.col(name).isNotNull()
    return keep & ~F.isnan(name) if dtype == "double" else keep


def select_ranks(
    long: DataFrame,
    wanted: Callable[[object, int], Sequence[int]],
    known: dict[object, tuple[int, float, float]] | None = None,
) -> tuple[dict[object, int], dict[object, dict[int, tuple]]]:
    """Values at given zero-based ranks of each series of ``long(series, x)``.

    ``wanted(series, n)`` names the ranks.  ``known`` gives each series' size and bounds on its
    values if the caller has them already.  Returns the sizes and, per series and
    rank, ``(value, rows below it, rows equal to it)``.
    """
    extent = known if known is not None else _extent(long)
    sizes = {s: n for s, (n, _, _) in extent.items()}
    found: dict[object, dict[int, tuple]] = {s: {} for s in sizes}
    active = []
    for series, (n, lo, hi) in extent.items():
        ranks = sorted(set(wanted(series, n)))
        if ranks:
            active.append(_Range(series, lo, hi, 0, n, ranks))
    while active:
        for r in active:
            if r.lo == r.hi:
                found[r.series].update({rank: (r.lo, r.below, r.count) for rank in r.ranks})
        active = [r for r in active if r.lo != r.hi]
        if active:
            fetch = sum(r.count for r in active) <= FETCH_ROWS
            active = _narrow(long, active, fetch)
    return sizes, found


@dataclass(frozen=True)
class _Range:
    """Values between ``lo`` and ``hi`` still in play for some ranks of a series."""

    series: object
    lo: float
    hi: float
    below: int
    count: int
    ranks: list[int]


def _extent(long: DataFrame) -> dict[object, tuple]:
    rows = (
        long.groupBy("series")
        .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .limit(MAX_SERIES + 1)
        .collect()
    )
    if len(rows) > MAX_SERIES:
        raise ValueError(f"more than {MAX_SERIES} series in one selection")
    return {r["series"]: (r["n"], r["lo"], r["hi"]) for r in rows}


def _narrow(long: DataFrame, active: list[_Range], fetch: bool) -> list[_Range]:
    """One pass: cut each range into cells and keep those that hold a wanted rank.

    With few rows left (``fetch``) every distinct value is a cell of its own.
    """
    kinds = dict(long.dtypes)
    ranges = long.sparkSession.createDataFrame(
        [(r.series, i, r.lo, r.hi, _pivot(r.lo, r.hi)) for i, r in enumerate(active)],
        f"series {kinds['series']}, part int, lo {kinds['x']}, hi {kinds['x']}, pivot double",
    )
    x, lo, hi, pivot = F.col("x"), F.col("lo"), F.col("hi"), F.col("pivot")
    even = F.least(F.floor((x - lo) / (hi - lo) * F.lit(float(CELLS))), F.lit(CELLS - 1))
    cell = x if fetch else F.when(pivot.isNotNull(), (x > pivot).cast("bigint")).otherwise(even)
    cells = (
        long.join(F.broadcast(ranges), "series")
        .filter((x >= lo) & (x <= hi))
        .groupBy("part", cell.alias("cell"))
        .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .drop("cell")
        .toArrow()
        .to_pylist()
    )
    by_part: dict[int, list] = {}
    for c in sorted(cells, key=lambda c: (c["part"], c["lo"])):
        by_part.setdefault(c["part"], []).append(c)
    kept = []
    for part, r in enumerate(active):
        start = r.below
        for c in by_part[part]:
            inside = [rank for rank in r.ranks if start <= rank < start + c["n"]]
            if inside:
                kept.append(_Range(r.series, c["lo"], c["hi"], start, c["n"], inside))
            start += c["n"]
    return kept


def _pivot(lo: float, hi: float) -> float | None:
    """Where to halve a range whose width is no finite number; None for all others."""
    if not math.isinf(hi - lo):
        return None
    if math.isinf(lo):
        return 0.0 if math.isinf(hi) else lo
    return sys.float_info.max if math.isinf(hi) else lo / 2 + hi / 2


def quantiles(df: DataFrame, probabilities: dict[str, Sequence[float]]) -> dict[str, dict[float, float]]:
    """Exact quantiles, interpolated linearly between neighbours; None for an empty column."""
    if not probabilities:
        return {}
    long = melt_numbers(df, list(probabilities))

    def ranks(series, n):
        spots = [(n - 1) * p for p in probabilities[series]]
        return [f(s) for s in spots for f in (math.floor, math.ceil)]

    sizes, found = select_ranks(long, ranks)
    result: dict[str, dict[float, float]] = {}
    for name, probs in probabilities.items():
        result[name] = {}
        for p in probs:
            if name not in sizes:
                result[name][p] = None
                continue
            spot = (sizes[name] - 1) * p
            low, high = math.floor(spot), math.ceil(spot)
            a, b = found[name][low][0], found[name][high][0]
            result[name][p] = a if low == high else (high - spot) * a + (spot - low) * b
    return result

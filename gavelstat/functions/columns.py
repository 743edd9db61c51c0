"""Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelstat.schema import METRIC_PREFIX, METRIC_REFUSED, SEVERITY_WEIGHTS

# A number written as text, in the form both pandas and SQL engines accept.  Java's
# own parser would also take a type suffix ('1d'), and some engines digit groups.
NUMERIC_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(value: Column) -> Column:
    """Text to double; whatever is not a finite decimal number becomes NULL."""
    parsed = F.trim(value).try_cast("double")
    return F.when(value.rlike(NUMERIC_TEXT) & (F.abs(parsed) < F.lit(float("inf"))), parsed)


def below(value: Column, limit: float, strict: bool = False) -> Column:
    """Whether a number in text is less than ``limit``, without rounding it.

    Decimals are cut, not rounded, after the eighteenth; what is cut off decides between a negative number and a
    limit that are equal so far.  Numbers too large for a decimal compare as doubles.  ``strict`` raises on text
    that does not parse, as a relational cast does; otherwise such rows compare as unknown and drop out.
    """
    long = F.length(value) > 20
    short = F.when(long, F.regexp_replace(value, r"(\.[0-9]{18})[0-9]+", "$1")).otherwise(value)
    decimal, edge = short.try_cast("decimal(38,18)"), F.lit(limit).cast("decimal(38,18)")
    more = long & (decimal == edge) & value.rlike(r"^\s*-[0-9]*\.[0-9]{18}0*[1-9]")
    double = value.cast("double") if strict else value.try_cast("double")
    return F.coalesce((decimal < edge) | more, double < limit)


def above(value: Column, limit: float, strict: bool = False) -> Column:
    """Whether a number in text is more than ``limit``, without rounding it; see ``below``."""
    return below(_negated(value), -limit, strict)


def _negated(value: Column) -> Column:
    """The text of the number's negative."""
    bare = F.trim(value)
    return F.when(bare.startswith("-"), F.substring(bare, 2, 1 << 30)).otherwise(
        F.concat(F.lit("-"), F.regexp_replace(bare, r"^\+", ""))
    )


def mean_parts(value: Column) -> dict[str, Column]:
    """Aggregates that add up over groups and from which ``mean_of_parts`` makes the mean of a text amount.

    A sum of doubles depends on the order rows arrive in; money should not.  Amounts that a decimal of twelve
    places holds are summed exactly, all others as doubles.
    """
    number = to_number(value)
    decimal = F.when(number.isNotNull(), F.trim(value).try_cast("decimal(30,12)"))
    exact = F.coalesce(decimal.cast("double") == number, F.lit(False))
    return {
        "exact_total": F.sum(F.when(exact, decimal)),
        "other_total": F.sum(F.when(~exact, number)),
        "amounts": F.count(number),
    }


def mean_of_parts(exact_total: Column, other_total: Column, amounts: Column) -> Column:
    total = F.coalesce(exact_total.cast("double"), F.lit(0.0)) + F.coalesce(other_total, F.lit(0.0))
    return F.try_divide(total, amounts)


def exact_mean(value: Column) -> Column:
    """Mean of all amounts in text that parse."""
    return mean_of_parts(*mean_parts(value).values())


def severity_weight(code: Column) -> Column:
    """Weight of a severity code; unknown or missing codes weigh 0."""
    weight = F.lit(0.0)
    for name, value in SEVERITY_WEIGHTS.items():
        weight = F.when(code == name, F.lit(value)).otherwise(weight)
    return weight


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    """Interior edges of ``bins`` equal-width intervals over [low, high]."""
    step = (high - low) / bins
    return [i * step + low for i in range(1, bins)]


def equal_width_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Zero-based number of the right-closed equal-width interval holding ``value``.

    Counting the edges below the value avoids the rounding slips of a division.
    A constant column has no width; its rows go to the middle interval.
    """
    if low == high:
        return F.when(value.isNotNull(), F.lit((bins - 1) // 2))
    return count_below(value, bin_edges(low, high, bins))


def count_below(value: Column, edges: Sequence[float]) -> Column:
    """How many of ``edges`` lie strictly below ``value``."""
    total = F.lit(0)
    for edge in edges:
        total = total + (value > F.lit(edge)).cast("int")
    return total


def row_hash(key: Column, seed: int) -> Column:
    """A 60-bit number from the md5 of seed and key; uniform and engine-independent."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def surrogate_key(*natural_key: Column) -> Column:
    """Row id in UUID form, derived from the natural key so that a retry repeats it."""
    digest = F.md5(F.concat_ws("|", *natural_key))
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in parts])


def metric_name(name: Column) -> Column:
    """Name of an importance metric, restricted to the characters metric stores accept."""
    return F.regexp_replace(F.concat(F.lit(METRIC_PREFIX), name), METRIC_REFUSED, "_")


def rounded(value: Column, digits: int = 6) -> Column:
    """Round for display; adding zero folds -0.0 into 0.0."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)
